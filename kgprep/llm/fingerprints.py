"""Document fingerprints: weighted SimHash, and search by permuted block tables.

Every term (a run of ``n`` words) has a 128-bit hash, whose set bits vote
+weight and clear bits -weight; the weight is 1 + ln(occurrences).  The
signs of the sums are the fingerprint.

Search: the 32 hex digits are cut into blocks.  Fingerprints that differ in
at most ``radius`` bits agree in all but ``radius`` blocks, so there is one
table for each choice of the blocks that may agree, keyed by them.  A query
probes each table and verifies the distance.  Tables hold distinct
fingerprints, so copies are one row.

``beside_next`` puts each document beside the next in descending id order.
Ids are range-partitioned into buckets, texts are shuffled once, and the
first document of a bucket is sent to the bucket before as a guest.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgprep.llm.common import map_texts, written

BITS, DIGITS = 128, 32
RADIUS, BLOCKS = 3, 4


def term_fingerprints(n: int = 3, chunk: int = 1 << 15, cache_words: int = 1 << 16):
    """``fingerprint(text)`` -> 32 hex digits; equal texts have equal fingerprints.

    A-Z are lower-cased, words are split at ASCII white space, and fewer
    than ``n`` words are one term.  A text without words has fingerprint 0.
    Word hashes are kept in a cache of at most ``cache_words`` words; bits
    are summed for ``chunk`` terms at a time.
    """
    import numpy as np
    import xxhash

    cache: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    u = np.uint64

    def word_hashes(words):
        if len(cache) > cache_words:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def mixed(x, seed):
        """The finaliser of SplitMix64, as a second and third hash of the same term."""
        x = x + u(seed)
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        return x ^ (x >> u(31))

    def fingerprint(text):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return "0" * DIGITS
        with np.errstate(over="ignore"):
            h, k = word_hashes(words), min(n, len(words))
            terms = np.zeros(len(words) - k + 1, np.uint64)
            for i in range(k):
                terms = mixed(terms, i + 1) + h[i:len(words) - k + 1 + i]
            terms, counts = np.unique(terms, return_counts=True)
            weights = (1 + np.log(counts)).astype(np.float32)
            votes = np.zeros(BITS)
            for at in range(0, len(terms), chunk):
                t, w = terms[at:at + chunk], weights[at:at + chunk]
                both = np.stack([mixed(t, 11), mixed(t, 12)], axis=1).astype(">u8").view(np.uint8)
                votes += 2 * (w @ np.unpackbits(both, axis=1).astype(np.float32)) - w.sum(dtype=np.float64)
        return np.packbits(votes > 0).tobytes().hex()

    return fingerprint


def fingerprint_documents(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) of every document row; a null text is empty."""
    def make():
        fingerprint = term_fingerprints(n)
        return lambda texts: [[fingerprint(t) for t in texts]]

    return map_texts(docs, ["doc_id"], make, "fp string")


def distance(a: str, b: str) -> Column:
    """Differing bits of two hex columns."""
    def half(c: str, at: int) -> Column:
        # two unsigned 32-bit halves keep conv() away from the sign
        parts = [F.conv(F.substring(c, at + 8 * i, 8), 16, 10).cast("bigint") for i in range(2)]
        return F.shiftleft(parts[0], 32).bitwiseOR(parts[1])

    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 17)), F.lit(0))


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[list[tuple[int, int]]]:
    """For each table, the (first digit, digits) blocks of its key."""
    if not radius < blocks <= DIGITS:
        raise ValueError("there must be more blocks than differing bits, and at most one a digit")
    cuts = [DIGITS * i // blocks for i in range(blocks + 1)]
    ranges = [(cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [list(c) for c in combinations(ranges, blocks - radius)]


def _keys(fp: str, tables) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("tab"), F.concat(*[F.substring(fp, a, n) for a, n in t]).alias("key"))
                     for i, t in enumerate(tables)])


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (q, fp, bits) with at most ``radius`` differing bits, for distinct
    ``queries`` against distinct ``fps`` (one column ``fp`` each)."""
    tables = block_tables(radius, blocks)
    index = fps.select("fp", F.explode(_keys("fp", tables)).alias("k")).select("fp", "k.*")
    probes = queries.select(F.col("fp").alias("q"), F.explode(_keys("fp", tables)).alias("k")).select("q", "k.*")
    pairs = probes.join(index, ["tab", "key"]).withColumn("bits", distance("q", "fp")).where(F.col("bits") <= radius)
    # found by several tables, it counts in the first in which the keys agree
    first = F.lit(None).cast("int")
    for i in range(len(tables) - 1, -1, -1):
        agree = F.lit(True)
        for at, digits in tables[i]:
            agree = agree & (F.substring("q", at, digits) == F.substring("fp", at, digits))
        first = F.when(agree, F.lit(i)).otherwise(first)
    return pairs.where(F.col("tab") == first).select("q", "fp", "bits")


def _id_buckets(docs: DataFrame, buckets: int):
    """Bucket bounds (descending ids) and, for each bucket, the (doc_id, h) of its first row.

    At most ``buckets`` ids and first rows reach the driver.
    """
    import numpy as np

    ids = docs.select("doc_id", F.xxhash64("text").alias("h"))
    cuts = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    bounds = np.array(sorted({min(int(c), (1 << 63) - 1) for c in cuts}), np.int64)

    def bucket_of(values):
        # ids as text: pandas would round integers beside a null
        known = values.notna().to_numpy()
        ids = np.array([int(v) if k else 0 for v, k in zip(values, known)], np.int64)
        at = len(bounds) - np.searchsorted(bounds, ids, side="right")
        return np.where(known, at, len(bounds) + 1)  # rows without an id come last

    return bounds, bucket_of


def beside_next(docs: DataFrame, make, columns: str, buckets: int | None = None) -> DataFrame:
    """(doc_id, *columns): ``make()(text, next_text)`` of each row and the next one in descending id order.

    Rows without an id come last; rows that share an id are ordered by a
    hash of their text; the last row's next is the first row.  Ids are
    integers.  A task holds one row besides its batch.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, bucket_of = _id_buckets(docs, buckets or 4 * parts)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids).astype("int32"))

    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"))
    keys = keys.select("doc_id", "h", bucket(F.col("doc_id").cast("string")).alias("b"))
    firsts = {r["b"]: (r["i"], r["h"]) for r in keys.groupBy("b").agg(F.max("doc_id").alias("i")).join(
        keys.groupBy("b", "doc_id").agg(F.min("h").alias("h")).withColumnRenamed("b", "b2"),
        (F.col("b") == F.col("b2")) & F.col("i").eqNullSafe(F.col("doc_id"))).select("b", "i", "h").collect()}
    used = sorted(firsts)
    # bucket b is followed by the first row of the next bucket in use, the last by the very first
    guest_of: dict[tuple, list[int]] = {}
    for before, after in zip(used, used[1:] + used[:1]):
        guest_of.setdefault(firsts[after], []).append(before)

    @F.pandas_udf("array<int>")
    def goes_to(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        keys = zip([None if pd.isna(i) else int(i) for i in ids], hashes)
        return pd.Series([guest_of.get(k, []) for k in keys])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("_own", bucket(F.col("doc_id").cast("string"))).withColumn("_to", goes_to(F.col("doc_id").cast("string"), "h"))
    own = F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("guest")))
    places = F.concat(own, F.transform("_to", lambda b: F.struct(b.alias("b"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "text", "h", F.explode(places).alias("p")).select("p.b", "p.guest", "doc_id", "text", "h")
    rows = rows.repartition(parts, "b").sortWithinPartitions("b", "guest", *order)

    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        held, f = None, make()
        for pdf in batches:
            ids, out = [], []
            for b, guest, doc, text in zip(*[pdf[c].tolist() for c in ("b", "guest", "doc_id", "text")]):
                if held is not None and held[0] == b:
                    ids.append(held[1])
                    out.append(f(held[2], text))
                # of repeated guests the first will do
                held = None if guest else (b, doc, text)
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "doc_id", ids)
            yield frame

    kind = docs.schema["doc_id"].dataType
    rows = rows.select("b", "guest", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, f"doc_id string, {columns}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def fingerprint_digest(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, query_every: int = 100) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and n_near for ids divisible by ``query_every``: the other rows whose fingerprint is
    within ``radius`` bits, by the block tables.

    A null text is empty.  Rows repeated exactly are rows of their own.
    """
    def make():
        import hashlib

        fingerprint, last = term_fingerprints(), [None, None]

        def both(text, after):
            text, after = text or "", after or ""
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            own = last[1] if text == last[0] else fingerprint(text)
            other, following = fingerprint(edited), fingerprint(after)
            last[:] = after, following  # the next row's own, as a rule
            alike = [1 - (int(own, 16) ^ int(f, 16)).bit_count() / BITS for f in (other, following)]
            return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, *alike

        return both

    rows = written(beside_next(docs.select("doc_id", "text"), make, (
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")), "fingerprints")
    classes = rows.groupBy(F.col("fingerprint").alias("fp")).agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("doc_id") % query_every == 0)).alias("asked"))
    classes = written(classes, "classes")
    found = within_radius(classes.select("fp"), classes.where("asked").select("fp"), radius, blocks)
    near = (found.join(classes.select("fp", "n"), "fp").groupBy(F.col("q").alias("fingerprint"))
            .agg((F.sum("n") - 1).alias("n_near")))
    rows = rows.join(written(near, "near"), "fingerprint", "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next", F.when(F.col("doc_id") % query_every == 0, F.col("n_near")).alias("n_near"))
