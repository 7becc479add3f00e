"""Best-fit packing of documents into sequences, certified by dual feasible functions.

A document is its token ids and a separator id.  Longer ones are cut into
full pieces (the first may be shorter); a full piece is a sequence of its
own.  The other pieces are dealt to partitions by a hash of their row, and
each partition packs its own by best-fit decreasing.  Two families of dual
feasible functions bound from below how many sequences any packing of the
partition needs; a partition that meets its bound is certified.

As long as more sequences are used than the bound on all pieces asks for,
partitions with a gap give the pieces of all sequences that are not full,
and certified ones those of their emptiest sequence.  These pieces are
dealt anew and repacked; a round that saves nothing ends the exchange.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgprep.llm.common import written

CAPACITY = 2048
PARTITION_PIECES = 50_000
ROUNDS = 6
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    """Path of the vocabulary file on this machine; executors resolve their own."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str | None = None, ranks: str | None = None):
    """``ids(text)`` -> uint32 array, equal to the ``tokenizers`` ids of the vocabulary file.

    The same vocabulary as ranks is about four times as fast.  Texts with the
    special token's string, which ``tokenizers`` takes for the token, go to
    ``tokenizers`` itself, and so does everything if only ``vocabulary`` is named.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary or default_vocabulary())

    def slow(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    if vocabulary and not ranks:
        return slow
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text):
        if not text:
            return np.zeros(0, np.uint32)
        return slow(text) if SPECIAL in text else np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None,
                    ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document row; a null text is empty."""
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(vocabulary, ranks)
        end = np.array([separator], "<u4")
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text or "").astype("<u4"), end])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[a:b].tobytes()
                    out.append((row, i, a, b - a, zlib.crc32(raw), raw))
            rows, *made = zip(*out) if out else [()] * 6
            # ids are taken from the batch as they are: pandas would round them beside a null
            docs_of = batch.column(0).take(pa.array(rows, pa.int64()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [docs_of, *[pa.array(v, t) for v, t in zip(made, types)]][:len(schema)], names=schema.names)

    added = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(added)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bin_bound(counts, capacity: int = CAPACITY) -> int:
    """A lower bound on the bins for ``counts[length]`` items, by dual feasible functions.

    For each threshold t, items longer than capacity - t count as a whole bin
    and items shorter than t as nothing.  For each k, a length x is rounded
    to floor((k + 1) x / capacity) / k bins unless (k + 1) x / capacity is whole.
    """
    import numpy as np

    counts = np.asarray(counts, np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    size = np.concatenate([[0], np.cumsum(counts * x)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(capacity // 2 + 1)
    between = size[capacity - t + 1] - size[t]
    longer = number[-1] - number[capacity - t + 1]
    best = int((longer + -(-between // capacity)).max())
    for k in range(1, 64):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity): whole values keep x / capacity
        value = np.where(whole, k * x, (scaled // capacity) * capacity)
        best = max(best, int(-(-(counts * value).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths, capacity: int = CAPACITY):
    """(bin, offset) of each length: the longest first, into the fullest bin that has room."""
    import numpy as np

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0  # bit r of the mask: some bin has r left
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - size
        if left:
            if not with_room[left]:
                mask |= 1 << left
            with_room[left].append(chosen)
    return bins, offsets, opened


def _pack_partitions(dealt: DataFrame, turn: int, capacity: int) -> DataFrame:
    """Packs (rid, length, part): adds turn, bin, offset, and the partition's bins and bound."""
    def run(pdf):
        import numpy as np

        lengths = pdf["length"].to_numpy()
        bins, offsets, opened = best_fit_decreasing(lengths, capacity)
        bound = bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        filled = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        emptiest = int(filled.argmin())
        return pd.DataFrame({"rid": pdf["rid"], "length": lengths, "turn": turn, "part": pdf["part"], "bin": bins,
                             "offset": offsets, "bins": opened, "gap": opened - bound, "filled": filled[bins],
                             "emptiest": bins == emptiest})

    return dealt.groupBy("part").applyInPandas(
        run, "rid long, length long, turn int, part int, bin long, offset long, bins long, gap long, filled long, "
             "emptiest boolean")


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES,
                 rounds: int = ROUNDS) -> DataFrame:
    """Packs rows (rid, length), with unique ``rid``, into (rid, turn, part, bin, offset)."""
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = [0] * (capacity + 1)
    for r in histogram:
        counts[r["length"]] = r["count"]
    goal = bin_bound(counts, capacity)

    def dealt(rows: DataFrame, n: int, turn: int) -> DataFrame:
        # pieces that are hard to place meet in larger partitions, up to eight times the first
        parts = max(1, -(-n // (partition_pieces << min(turn, 3))))
        return rows.select("rid", "length", F.pmod(F.xxhash64(F.lit(turn), "rid"), F.lit(parts)).cast("int").alias("part"))

    def used(rows: DataFrame) -> int:
        return rows.where("offset = 0").count()

    state = written(_pack_partitions(dealt(pieces, sum(counts), 0), 0, capacity), "packed")
    total = used(state)
    for turn in range(1, rounds):
        if total <= goal:
            break
        open_bin = (F.col("filled") < capacity) & ((F.col("gap") > 0) | F.col("emptiest"))
        pool, rest = state.where(open_bin), state.where(~open_bin)
        again = _pack_partitions(dealt(pool, pool.count(), turn), turn, capacity)
        tried = written(rest.unionByName(again), "packed")
        now = used(tried)
        if now >= total:
            break
        state, total = tried, now
    return state.select("rid", "turn", "part", "bin", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, vocabulary: str | None = None,
                   ranks: str | None = None, keep_ids: bool = False,
                   partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A null or empty text is the separator alone.  Rows repeated exactly and
    rows without an id are documents like any other; other columns are not
    read.  An empty table gives no pieces.
    """
    pieces = document_pieces(docs, capacity, separator, vocabulary, ranks, keep_ids)
    pieces = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("rid", "length")
    placed = pack_lengths(short, capacity, partition_pieces)
    # sequences of the exchange rounds: turn, partition and bin; full pieces: below zero
    number = ((F.col("turn").cast("long") * (1 << 24) + F.col("part")) * (1 << 32) + F.col("bin"))
    placed = placed.select("rid", number.alias("sequence_id"), "offset")
    out = pieces.join(placed, "rid", "left")
    full = F.col("length") == capacity
    return out.select("doc_id", "piece", "start", "length", "ids_crc32",
                      F.when(full, -1 - F.col("rid")).otherwise(F.col("sequence_id")).alias("sequence_id"),
                      F.when(full, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"),
                      *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, little-endian, from pieces with ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate(
        "p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
