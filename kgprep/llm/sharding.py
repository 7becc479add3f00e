"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key walks through the shard counts at which it would move
(``jumps``); the last one below ``n_shards`` is its shard.  There is no ring
table: the shard depends on the key and the count alone, and appending a
shard moves a key only into the new shard, with probability 1/(n+1).

Everything is a projection, apart from the slots.  Slots are ranks inside a
shard.  The narrow assignment rows are written once, and each written file
is cut into chunks of ``CHUNK`` rows; a rank inside ``(shard, chunk)`` plus
the running size of earlier chunks is the slot.  Chunks are bounded whatever
the keys are, so a key or source that holds a third of the rows is no
special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.llm.common import written

# Fixed values of the published algorithm: its linear congruential step.
LCG_MULTIPLIER = 2862933555777941757
TWO_64, TWO_33, TWO_31 = 1 << 64, 1 << 33, 1 << 31

SHORT_WALK = 64
CHUNK = 65_536


def unsigned_key(key: Column) -> Column:
    """A signed 64-bit hash as an unsigned DECIMAL(20,0)."""
    wide = key.cast("decimal(20,0)")
    return F.when(wide < 0, wide + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _dec(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def jump_shard(key: Column, n_shards: int) -> Column:
    """Shard of an unsigned DECIMAL(20,0) ``key`` among ``n_shards``.

    The walk is a fold over a fixed number of steps that does nothing once it
    has passed ``n_shards``.  A walk takes about ln(n) steps, and never more
    than n + 1; the rare key that is not done after ``SHORT_WALK`` steps is
    folded over all n + 1.  The step's product is below 10^38, so decimals
    hold it exactly under ANSI arithmetic.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    start = F.struct(key.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(acc: Column, _: Column) -> Column:
        k = ((acc["k"] * _dec(LCG_MULTIPLIER) + F.lit(1)) % _dec(TWO_64)).cast("decimal(20,0)")
        high = ((k - k % _dec(TWO_33)) / _dec(TWO_33)).cast("bigint").cast("double")  # exact: a whole quotient
        jump = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(TWO_31)) / (high + F.lit(1.0)))).cast("bigint")
        return F.when(acc["j"] >= n_shards, acc).otherwise(
            F.struct(k.alias("k"), acc["j"].alias("b"), jump.alias("j")))

    def walk(steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    if n_shards + 1 <= SHORT_WALK:
        return walk(n_shards + 1)["b"].cast("int")
    short = walk(SHORT_WALK)
    return F.when(short["j"] >= n_shards, short["b"]).otherwise(walk(n_shards + 1)["b"]).cast("int")


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard once one is appended).

    The key is hashed with XXH64, so any type of key will do.  A null key is
    one key like any other; repeated rows go to the same shard.
    """
    k = unsigned_key(F.xxhash64(F.col(key)))
    return docs.select("*", jump_shard(k, n_shards).alias("shard"), jump_shard(k, n_shards + 1).alias("grown_shard"))


def with_slots(assigned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each shard, without a task per shard."""
    files = written(assigned, "shards")
    rows = files.select("*", F.col("_metadata.file_name").alias("_file"),
                        F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_row") / chunk))
    place = ["shard", "_file", "_chunk"]
    sizes = rows.groupBy(*place).count()
    before = Window.partitionBy("shard").orderBy("_file", "_chunk").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(*place, (F.sum("count").over(before) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("_row"))
    return (rows.withColumn("_rank", rank).join(offsets, place)
            .select(*assigned.columns, (F.col("_before") + F.col("_rank") - 1).alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 8; a null text has length 0 and the CRC
    of the empty string.  Other columns of ``docs`` are ignored.  An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"),
                         F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    out = with_slots(assign_shards(narrow, n_shards))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
