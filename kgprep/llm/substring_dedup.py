"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else.

Two equal windows of ``length`` bytes have the same anchor, the first of their ``GRAM``-byte strings
with the smallest hash.  So windows are grouped by anchor, and a
suffix array is only needed where an anchor occurs more than once:

1. Each document is cut into runs of windows with one anchor (winnowing).
   A run's bytes, from its first window to the end of its last, are its
   content.  Runs are stored with 128 bits of their content's hash.
2. Anchors that occur once are done: their windows are unique.  A run with
   the same content as another is repeated as a whole.  Rows of an anchor or content that
   holds a large share of all are spread over several tasks.
3. Of anchors with different contents, one run for each content is
   brought together with the others in a shard, whose suffix array is built by
   induced sorting; windows whose permuted common prefix reaches ``length``
   are repeated.
4. Spans are merged by document and the bytes removed.

A shard holds whole anchors, so all equal windows meet in it.  An anchor
whose contents exceed ``SHARD_BYTES`` is not put into one task: its windows are
counted by 128-bit hash, one row a window, combined before the shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import broadcast_if_small, written
from kgprep.llm.suffix_arrays import permuted_common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
SHARD_BYTES = 2 << 20
CHUNK = 1 << 18  # windows of a long text are cut into runs this many at a time
BROADCAST_BYTES = 32 << 20
HEAVY = 256  # a key with more than this share of the rows is spread
SALTS = 64


def rolling_hashes(seed: int):
    """``prefix(bytes)`` and ``window(prefix, start, stop)``: 64-bit hashes of substrings in constant time."""
    import numpy as np

    random = np.random.default_rng(seed)
    values = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(random.integers(1 << 61, 1 << 62)) * 8 + 5
    inverse = pow(base, -1, 1 << 64)
    powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

    def power(kind, n):
        p = powers[kind]
        factor = base if kind == "up" else inverse
        with np.errstate(over="ignore"):
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(factor, len(p), 1 << 64))])
        powers[kind] = p
        return p

    def prefix(raw):
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power("up", len(raw))[:len(raw)])])

    def window(sums, start, stop):
        with np.errstate(over="ignore"):
            x = (sums[stop] - sums[start]) * power("down", len(sums))[start]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            return x ^ (x >> np.uint64(29))

    return prefix, window


def anchored_runs(length: int = LENGTH, gram: int = GRAM):
    """``runs(raw)`` -> (anchor hash, content hash 1, content hash 2, first window, last window) arrays."""
    import numpy as np

    (prefix, window), (prefix2, window2) = rolling_hashes(1), rolling_hashes(2)
    span = length - gram + 1  # gram positions in a window

    def runs(raw):
        n = len(raw) - length + 1
        empty = np.zeros(0, np.int64)
        if n <= 0:
            return (empty,) * 5
        out = []
        for at in range(0, n, CHUNK):
            part = raw[at:min(len(raw), at + CHUNK + length - 1)]
            windows = len(part) - length + 1
            sums, sums2 = prefix(part), prefix2(part)
            places = np.arange(len(part) - gram + 1)
            grams = window(sums, places, places + gram)
            # the hash in front, the place behind: of equal hashes the first is the smallest
            low = (grams & ~np.uint64((1 << 20) - 1)) | places.astype(np.uint64)
            width = 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[:windows], low[span - width:span - width + windows])
            anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
            first = np.nonzero(np.append(True, anchor[1:] != anchor[:-1]))[0]
            last = np.append(first[1:], windows) - 1
            stop = last + length
            # content: its bytes, and where the anchor is in it
            where = (anchor[first] - first).astype(np.uint64) << np.uint64(40)
            out.append((grams[anchor[first]].view(np.int64),
                        (window(sums, first, stop) ^ where).view(np.int64),
                        (window2(sums2, first, stop) ^ (last - first).astype(np.uint64)).view(np.int64),
                        first + at, last + at))
        return tuple(np.concatenate(c) for c in zip(*out))

    return runs


def as_bytes(text):
    import numpy as np

    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """Stored (doc, t1, g, h1, h2, first, last); doc is the id as text."""
    def run(batches):
        import numpy as np

        runs = anchored_runs(length)
        for pdf in batches:
            found = [runs(as_bytes(t)) for t in pdf["text"]]
            sizes = [len(f[0]) for f in found]
            frame = {"doc": np.repeat(pdf["doc"].to_numpy(object), sizes), "t1": np.repeat(pdf["t1"].to_numpy(), sizes)}
            for i, name in enumerate(("g", "h1", "h2", "first", "last")):
                frame[name] = np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
            yield pd.DataFrame(frame)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), F.xxhash64("text").alias("t1"), "text")
    return written(rows.mapInPandas(run, "doc string, t1 long, g long, h1 long, h2 long, first long, last long"), "runs")


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` (doc and first among their columns) whose key is in ``keys``, which has the number of rows of each as n.

    Keys that hold more than one row in ``HEAVY`` are fewer than ``HEAVY``, so they are broadcast;
    their rows are spread over ``SALTS`` parts.  All others meet by a shuffle.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    salts = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = keys.select(*on, "n", F.explode(salts).alias("salt"))
    spread = F.broadcast(keys.where(heavy & (F.col("salt") == 0)).select(*on, F.lit(SALTS).alias("parts")))
    rows = rows.join(spread, on, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc", "first"), F.col("parts")), F.lit(0)).cast("int"))
    return rows.join(keys, [*on, "salt"], "left_semi").drop("parts", "salt")


def repeated_windows(length: int = LENGTH):
    """``repeated(segments)`` -> for each segment a boolean per window: does it occur elsewhere in the segments."""
    import numpy as np

    def repeated(segments):
        # every segment ends in a symbol of its own, so no common prefix crosses it; 0 ends the string
        k = len(segments)
        parts, at = [], []
        place = 0
        for i, raw in enumerate(segments):
            parts += [np.frombuffer(raw, np.uint8).astype(np.int32) + (k + 1), np.array([i + 1], np.int32)]
            at.append(place)
            place += len(raw) + 1
        x = np.concatenate([*parts, np.zeros(1, np.int32)])
        del parts
        order = suffix_array(x)
        phi, plcp = permuted_common_prefixes(x, order)
        long = plcp >= length
        hit = long.copy()
        hit[phi[long]] = True
        return [hit[a:a + len(raw) - length + 1] for a, raw in zip(at, segments)]

    return repeated


def _spans(hits, first, length):
    """Covered [start, stop) byte ranges of the repeated windows, which begin at ``first``."""
    import numpy as np

    places = np.nonzero(hits)[0]
    if not len(places):
        return []
    cut = np.nonzero(np.diff(places) > length)[0]
    begin, end = np.append(places[0], places[cut + 1]), np.append(places[cut], places[-1])
    return list(zip((begin + first).tolist(), (end + first + length).tolist()))


def _segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc, t1, g, n, first, seg): the content of the wanted runs."""
    keys = written(wanted.select("doc", "t1").distinct(), "wanted")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), F.xxhash64("text").alias("t1"), "text")
    # rows repeated exactly give the same content: one will do
    small = broadcast_if_small(keys, BROADCAST_BYTES)
    rows = rows.join(small.withColumnsRenamed({"doc": "_d", "t1": "_t"}),
                     F.col("doc").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t")), "left_semi")
    rows = rows.dropDuplicates(["doc", "t1"])
    lists = wanted.groupBy(F.col("doc").alias("_d"), F.col("t1").alias("_t")).agg(
        F.collect_list(F.struct("g", "n", "first", "last")).alias("runs"))
    rows = rows.join(lists, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t")))

    def run(batches):
        for pdf in batches:
            out = []
            for doc, t1, text, runs in zip(pdf["doc"], pdf["t1"], pdf["text"], pdf["runs"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(doc, t1, r["g"], r["n"], r["first"], raw[r["first"]:r["last"] + length]) for r in runs]
            yield pd.DataFrame(out, columns=["doc", "t1", "g", "n", "first", "seg"])

    return rows.select("doc", "t1", "text", "runs").mapInPandas(
        run, "doc string, t1 long, g long, n long, first long, seg binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, t1, start, stop): byte ranges that cover all repeated windows."""
    runs = run_table(docs, length)
    # most anchors occur once: their runs go no further
    anchors = written(runs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    runs = written(semi_join(runs, anchors, ["g"]), "shared-runs")
    # one run for each content, combined before the shuffle; text keys break the tie, whatever the order of rows
    contents = runs.groupBy("g", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "t1", "first", "last")).alias("r")).select("g", "h1", "h2", "n", "r.*")
    contents = written(contents, "contents")
    copies = contents.where("n > 1").select("g", "h1", "h2", "n")
    whole = semi_join(runs, copies, ["g", "h1", "h2"]).select(
        "doc", "t1", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    mixed = contents.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
    mixed = contents.join(written(mixed, "mixed"), "g", "left_semi")

    segments = written(_segments(docs, mixed, length), "segments")
    sizes = segments.groupBy("g").agg(F.sum(F.octet_length("seg")).alias("size"))
    sizes = written(sizes, "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.where(F.col("size") > shard_bytes).select("g")
    large = broadcast_if_small(large, BROADCAST_BYTES)
    shards = max(1, -(-2 * total // shard_bytes))
    spans_of = "doc string, t1 long, start long, stop long"

    def sort_shard(pdf):
        out = []
        hits = repeated_windows(length)(pdf["seg"].tolist())
        for doc, t1, n, first, hit in zip(pdf["doc"], pdf["t1"], pdf["n"], pdf["first"], hits):
            if n == 1:  # the runs of a content with copies are whole spans already
                out += [(doc, t1, a, b) for a, b in _spans(hit, first, length)]
        return pd.DataFrame(out, columns=["doc", "t1", "start", "stop"])

    sharded = segments.join(large, "g", "left_anti").withColumn(
        "shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("long"))
    sorted_spans = sharded.groupBy("shard").applyInPandas(sort_shard, spans_of)

    def window_hashes(batches):
        import numpy as np

        pairs = rolling_hashes(3), rolling_hashes(4)
        for pdf in batches:
            for doc, t1, n, first, seg in zip(pdf["doc"], pdf["t1"], pdf["n"], pdf["first"], pdf["seg"]):
                raw = np.frombuffer(seg, np.uint8)
                at = np.arange(len(raw) - length + 1)
                h = [w(p(raw), at, at + length).view(np.int64) for p, w in pairs]
                yield pd.DataFrame({"doc": doc, "t1": t1, "n": n, "at": at + first, "w1": h[0], "w2": h[1]})

    windows = segments.join(large, "g", "left_semi").mapInPandas(
        window_hashes, "doc string, t1 long, n long, at long, w1 long, w2 long")
    counted = written(windows.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1"), "windows")
    crowded = windows.where("n = 1").join(counted.select("w1", "w2"), ["w1", "w2"], "left_semi").select(
        "doc", "t1", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
    return whole.unionByName(sorted_spans).unionByName(crowded)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (the remaining bytes) added.

    A null text is empty.  Rows repeated exactly are documents of their own,
    so they lose every byte if they are long enough.  Names that clash with
    the added columns are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    carried = [c for c in docs.columns if c not in added]
    spans = written(repeated_spans(docs.select("doc_id", "text"), length), "spans")
    # spans that touch become one before a document's are collected: a periodic text has one a byte
    spans = spans.groupBy("doc", "t1", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy("doc", "t1").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("apart", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("long"))
    spans = spans.withColumn("run", F.sum("apart").over(order))
    spans = spans.groupBy("doc", "t1", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    merged = spans.groupBy(F.col("doc").alias("_d"), F.col("t1").alias("_t")).agg(
        F.collect_list(F.struct("start", "stop")).alias("_spans"))
    merged = written(merged, "merged")
    rows = docs.select(F.struct(*carried).alias("_row"), F.col("doc_id").cast("string").alias("_doc"),
                       F.xxhash64("text").alias("_key"))
    rows = rows.join(merged, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left")
    raw = F.coalesce(F.col("_row.text"), F.lit("")).cast("binary")

    # spans in order: the kept bytes are those between the furthest end so far and the next start
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("removed"),
                     F.lit(0).cast("long").alias("n"),
                     F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("gaps"))

    def step(acc, s):
        apart = s["start"] > acc["end"]
        # a span that begins where the last one ended prolongs it
        new = apart | (acc["n"] == 0)
        gap = F.struct(acc["end"].alias("start"), s["start"].alias("stop"))
        return F.struct(
            F.greatest(acc["end"], s["stop"]).alias("end"),
            (acc["removed"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("removed"),
            (acc["n"] + new.cast("long")).alias("n"),
            F.when(apart, F.array_append(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    folded = F.aggregate(F.array_sort("_spans"), begin, step)
    rows = rows.select("_row", raw.alias("_raw"), F.when(F.col("_spans").isNotNull(), folded).alias("_f"))
    size = F.octet_length("_raw").cast("long")
    gaps = F.concat(F.col("_f.gaps"), F.array(F.struct(F.col("_f.end").alias("start"), size.alias("stop"))))
    pieces = F.transform(gaps, lambda g: F.substring(F.col("_raw"), (g["start"] + 1).cast("int"),
                                                     (g["stop"] - g["start"]).cast("int")))
    kept = F.when(F.col("_f").isNull(), F.col("_raw")).otherwise(
        F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p)))
    return rows.select(*[F.col("_row")[c].alias(c) for c in carried], size.alias("n_bytes"),
                       F.coalesce(F.col("_f.removed"), F.lit(0)).cast("long").alias("n_removed"),
                       F.coalesce(F.col("_f.n"), F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept"))


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document row."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
