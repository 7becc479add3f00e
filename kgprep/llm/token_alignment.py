"""Cross-tokenizer alignment by lockstep merging.

A text's tokens under two tokenizers A and B are two cuttings of the same
bytes.  Two pointers walk them: the tokens they point at overlap and are a
link; then the pointer whose token ends first goes on, or both where both
end, which is a cut between groups.

1. A task takes documents a few megabytes at a time.  Their token ends, as offsets
   into all their bytes, are two sorted vectors.  The bytes of each document
   are lanes of at most ``LANE`` bytes; one NumPy state vector holds the pointers of
   all lanes of all documents, each step advances all, and lanes that are
   done leave it.  A long document is many lanes and takes no more steps than a short one.
2. A document's links are stored as distinct id pairs with how often each occurs.
3. A pair's count is the number of documents that hold it; an A id's best
   count is the largest of its pairs'.  Both are counted over all documents.
4. The most frequent pairs, at most ``HEAD_PAIRS`` of them, go to every task.
   Entries with a rarer pair meet its count by a shuffle join.  A pair that
   most documents hold is in the first part, so no join key is hot.

Neither tokenizer joins bytes across a space that stands between two
other characters (checked for the pieces of B; given by the pattern of A), so stretches between
such spaces are tokenised once and remembered, up to a bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgprep.llm.common import written

LANE = 256
SLICE_BYTES = 2 << 20
HEAD_PAIRS = 1 << 21
WIDTH = 1 << 15  # more than the ids of B; a pair is a * WIDTH + b
REMEMBERED = 1 << 19  # stretches
STRETCH = 64  # characters of the longest one that is remembered


class Stretches:
    """Token ids of A and B for the stretches of texts."""

    def __init__(self, ranks: str | None = None, pieces: str | None = None):
        import base64
        import re

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            entries = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={})
        self.a_bytes = {rank: word for word, rank in entries.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        n = self.b.get_piece_size()
        if n > WIDTH:
            raise ValueError(f"the second tokenizer has {n} ids; WIDTH allows {WIDTH}")
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        probe = "a① ﬁ ÅÅ  \t　x"
        self.apart = not any(re.search("[^▁]▁", p) for p in names) and self.b.normalize(probe) in (
            probe.replace(" ", "▁"), "▁" + probe.replace(" ", "▁"))
        self.forget()

    def forget(self):
        from array import array

        # -1: not to be split at the spaces around it
        self.known = {}
        self.a_ids, self.b_ids = array("H"), array("H")
        self.a_at, self.b_at, self.whole = array("q", [0]), array("q", [0]), array("b")

    def add(self, text: str) -> int:
        raw = b" " + text.encode("utf-8", "surrogatepass")
        try:
            a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
            same = raw == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b])
        except UnicodeError:
            a, b, same = [], [], False
        self.a_ids.extend(a)
        self.b_ids.extend(b)
        self.a_at.append(len(self.a_ids))
        self.b_at.append(len(self.b_ids))
        self.whole.append(same)
        return len(self.whole) - 1

    def number(self, text: str) -> int:
        k = self.known.get(text)
        if k is None or k < 0:
            k = self.add(text)
            if len(text) <= STRETCH:
                self.known[text] = k
        return k

    def of(self, text: str) -> list[int]:
        """Numbers of the stretches of a text that is not empty."""
        if not self.apart:
            return [self.add(text)]
        parts = text.split(" ")
        numbers = list(map(self.known.get, parts))
        if None in numbers:
            for i, p in enumerate(parts):
                if numbers[i] is None:
                    clean = p and not p[0].isspace() and not p[-1].isspace()
                    if clean:
                        numbers[i] = self.number(p)
                    else:
                        numbers[i] = -1
                        if len(p) <= STRETCH:
                            self.known[p] = -1
        if -1 not in numbers:
            return numbers
        out, run = [], []
        for i, p in enumerate(parts):
            # a space is a boundary if the parts on both sides are clean
            if run and numbers[i] >= 0 and numbers[i - 1] >= 0:
                out.append(numbers[i - 1] if len(run) == 1 else self.joined(run))
                run = []
            run.append(p)
        out.append(numbers[-1] if len(run) == 1 and numbers[-1] >= 0 else self.joined(run))
        return out

    def joined(self, run: list[str]) -> int:
        text = " ".join(run)
        # its own name: the text of a run can be that of a part that is not to be split
        k = self.known.get((text,))
        if k is None:
            k = self.add(text)
            if len(text) <= STRETCH:
                self.known[(text,)] = k
        return k


def ragged(starts, lengths):
    """Positions ``start, start + 1, ...`` of all runs, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def lockstep(a_end, b_end, doc_start, doc_stop):
    """(i, j, cut): all overlapping tokens in order, and whether both end there.

    ``a_end`` and ``b_end`` are the sorted ends of all tokens as offsets into all
    bytes; documents begin at ``doc_start`` and end at ``doc_stop``, each with tokens up to its end.
    """
    lanes = np.maximum(1, -(-(doc_stop - doc_start) // LANE))
    first = np.repeat(doc_start, lanes)
    begin = first + ragged(np.zeros(len(lanes), np.int64), lanes) * LANE
    stop = np.minimum(begin + LANE, np.repeat(doc_stop, lanes))
    i, j = np.searchsorted(a_end, begin, side="right"), np.searchsorted(b_end, begin, side="right")
    # a link belongs to the lane in which its overlap starts
    starts = np.maximum(np.append(0, a_end)[i], np.append(0, b_end)[j])
    emit = starts >= begin
    found = []
    while len(i):
        ea, eb = a_end[i], b_end[j]
        cut = ea == eb
        if emit is None:
            found.append((i, j, cut))
        else:
            found.append((i[emit], j[emit], cut[emit]))
            emit = None
        more = np.minimum(ea, eb) < stop
        i, j = i + (ea <= eb), j + (eb <= ea)
        if not more.all():
            i, j, stop = i[more], j[more], stop[more]
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    i, j, cut = (np.concatenate(c) for c in zip(*found))
    # along the merge each step advances a pointer, so i + j orders all links
    place = np.full(int((i + j).max()) + 1, -1)
    place[i + j] = np.arange(len(i))
    order = place[place >= 0]
    return i[order], j[order], cut[order]


def packed(pairs, times):
    """Bytes of sorted distinct pairs (differences, by byte planes) and of how often each occurs (at most 255; more repeat the pair)."""
    import zstandard

    again = -(-times // 255)
    if (again > 1).any():
        last = np.cumsum(again) - 1
        pairs = np.repeat(pairs, again)
        full = np.full(len(pairs), 255)
        full[last] = times - 255 * (again - 1)
        times = full
    planes = np.diff(pairs, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + times.astype(np.uint8).tobytes())


def unpacked(raw):
    """(pairs, times) of ``packed``."""
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(flat) // 5
    planes = np.ascontiguousarray(flat[:4 * n].reshape(4, n).T)
    return np.cumsum(planes.view("<u4").ravel().astype(np.int64)), flat[4 * n:].astype(np.int64)


class Names:
    """Group texts: decimal ids with the sign that follows each."""

    def __init__(self, a_ids: int = 1 << 16, b_ids: int = 1 << 16):
        self.signs = [f"{i}{s}" for s in ",|" for i in range(a_ids)] + [f"{i}{s}" for s in ",;" for i in range(b_ids)]
        self.a_ids, self.b_ids = a_ids, b_ids

    def texts(self, a, b, i, j, cut, a_stop, b_stop):
        """One text for each document; its tokens of A end at ``a_stop``, those of B at ``b_stop``."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i[cut]] = 1
        last_b[j[cut]] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = np.concatenate([a + self.a_ids * last_a, 2 * self.a_ids + b + self.b_ids * last_b])[order].tolist()
        at, signs, out = 0, self.signs.__getitem__, []
        for stop in (a_stop + b_stop).tolist():
            out.append("".join(map(signs, code[at:stop]))[:-1])
            at = stop
        return out


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, {groups} string, pairs binary"


def aligned_documents(docs: DataFrame, carried: list[str], digest: bool, ranks: str | None, pieces: str | None) -> DataFrame:
    """``carried``, then n_a, n_b, n_groups, n_links, the groups (or their SHA-256) and the packed links."""
    schema = StructType([docs.schema[c] for c in carried] + StructType.fromDDL(
        ALIGNED.format(groups="groups_sha256" if digest else "groups")).fields)

    def align(texts, known, names):
        import hashlib

        n = len(texts)
        empty = (0, 0, 0, 0, "", packed(np.zeros(0, np.int64), np.zeros(0, np.int64)))
        numbers = [known.of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, numbers), np.int64, n)
        flat = np.fromiter((k for row in numbers for k in row), np.int64, int(sizes.sum()))
        whole = np.array(known.whole, bool)[flat] if len(flat) else np.zeros(0, bool)
        row = np.repeat(np.arange(n), sizes)
        good = (sizes > 0) & (np.bincount(row[~whole], minlength=n) == 0)
        flat, row = flat[good[row]], row[good[row]]
        if not len(flat):
            return [empty] * n
        ids, lengths, stops = [], [], []
        for at, of, sizes_of in ((known.a_at, known.a_ids, names.a_size), (known.b_at, known.b_ids, names.b_size)):
            at, of = np.array(at, np.int64), np.array(of, np.int64)
            count = at[flat + 1] - at[flat]
            ids.append(of[ragged(at[flat], count)])
            lengths.append(sizes_of[ids[-1]])
            stops.append(np.cumsum(np.bincount(row, weights=count, minlength=n).astype(np.int64)))
        (a, b), (a_stop, b_stop) = ids, stops
        a_end, b_end = (np.cumsum(x) for x in lengths)
        doc_stop = np.append(0, a_end)[a_stop]
        doc_start = np.append(0, doc_stop[:-1])
        i, j, cut = lockstep(a_end, b_end, doc_start[good], doc_stop[good])
        link_row = np.searchsorted(a_stop, i, side="right")
        n_links = np.bincount(link_row, minlength=n)
        n_groups = np.bincount(link_row[cut], minlength=n)
        key, times = np.unique((link_row << 32) | (a[i] * WIDTH + b[j]), return_counts=True)
        at = np.searchsorted(key >> 32, np.arange(n + 1))
        key &= (1 << 32) - 1
        groups = names.texts(a, b, i, j, cut, a_stop, b_stop)
        n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        return [(int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]),
                 hashlib.sha256(groups[d].encode()).hexdigest() if digest else groups[d],
                 packed(key[at[d]:at[d + 1]], times[at[d]:at[d + 1]])) if good[d] else empty for d in range(n)]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        known, names = Stretches(ranks, pieces), Names()
        names.a_size, names.b_size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for i, word in known.a_bytes.items():
            names.a_size[i] = len(word)
        names.b_size[:len(known.b_bytes)] = [len(w) for w in known.b_bytes]
        types = [to_arrow_type(f.dataType) for f in schema.fields[len(carried):]]
        for batch in batches:
            texts = batch.column(len(carried))
            size = texts.nbytes // max(1, len(texts)) + 1
            step = max(1, SLICE_BYTES // size)
            for at in range(0, len(texts), step):
                found = align(texts.slice(at, step).to_pylist(), known, names)
                made = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(at, step) for k in range(len(carried))], *made], names=schema.names)
                if len(known.whole) > REMEMBERED or len(known.a_ids) > 8 * REMEMBERED:
                    known.forget()

    return docs.select(*carried, F.col("text").alias("_text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Stored (pair, n, best): how many documents hold the pair, and whether no other pair of its A id is held by more."""
    def distinct(batches):
        import pyarrow as pa

        def out(parts):
            pairs, counts = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

        parts, held = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs, _ = unpacked(raw)
                # a pair repeated for its number of times counts once
                parts.append(pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs)
                held += len(pairs)
                if held > 1 << 22:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    counts = written(aligned.select("pairs").mapInArrow(distinct, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = F.col("pair").bitwiseAND(F.lit(-WIDTH))
    most = counts.groupBy(of_a.alias("_a")).agg(F.max("n").alias("_most"))
    return written(counts.join(most, of_a == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "pair-best")


def link_sums(aligned: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(rid, n_best, count_sum) of the documents with links."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = -(-total // head_pairs) if counts.count() > head_pairs else 1  # at most head_pairs pairs have as many
    top = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    sc = aligned.sparkSession.sparkContext
    head = sc.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def look_up(batches):
        import pyarrow as pa

        names, n, best = head.value
        for batch in batches:
            rids, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for first in range(0, len(raws), 256):
                found = [unpacked(r) for r in raws[first:first + 256]]
                pairs, times = (np.concatenate(c) for c in zip(*found))
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                at = np.minimum(np.searchsorted(names, pairs), max(0, len(names) - 1))
                hit = names[at] == pairs if len(names) else np.zeros(len(pairs), bool)
                sums, bests = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                np.add.at(sums, row[hit], times[hit] * n[at[hit]])
                np.add.at(bests, row[hit], times[hit] * best[at[hit]])
                rest = ~hit
                ids = rids[first:first + 256]
                m = int(rest.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, ids[row[rest]]])),
                     pa.array(np.concatenate([np.zeros(len(ids), np.int64), pairs[rest]]), mask=np.repeat([True, False], [len(ids), m])),
                     pa.array(np.concatenate([np.zeros(len(ids), np.int64), times[rest]])),
                     pa.array(np.concatenate([bests, np.zeros(m, np.int64)])),
                     pa.array(np.concatenate([sums, np.zeros(m, np.int64)]))],
                    names=["rid", "pair", "times", "n_best", "count_sum"])

    looked = written(aligned.where("n_links > 0").select("rid", "pairs").mapInArrow(
        look_up, "rid long, pair long, times long, n_best long, count_sum long"), "looked-up")
    known = looked.where("pair IS NULL").select("rid", "n_best", "count_sum")
    rare = looked.where("pair IS NOT NULL").join(counts.where(F.col("n") < least), "pair").select(
        "rid", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return known.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(docs: DataFrame, digest: bool = False, head_pairs: int = HEAD_PAIRS,
                     ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, groups, n_best and count_sum added.

    ``groups`` holds all ids as ``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256 is returned as groups_sha256
    instead.  Null and empty texts, and texts that the tokens of A or B do not
    give back (B knows no U+2581), have no tokens: zeros and ''.  Rows repeated exactly are
    documents of their own, also for the counts.  Names that clash with added columns are replaced.
    """
    added = {"n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum", "text"}
    carried = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*carried).alias("_row"), "text")
    out = aligned_documents(rows, ["_row"], digest, ranks, pieces)
    out = written(out.withColumn("rid", F.monotonically_increasing_id()), "aligned")
    sums = link_sums(out, pair_counts(out), head_pairs)
    groups = "groups_sha256" if digest else "groups"
    zero = F.lit(0).cast("long")
    return out.drop("pairs").join(sums, "rid", "left").select(
        *[F.col("_row")[c].alias(c) for c in carried], "n_a", "n_b", "n_groups", "n_links", groups,
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
