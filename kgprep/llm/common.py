"""Helpers shared by the operators: written tables, ASCII folding, skew-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgprep.session import scratch_path

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and
    a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` has a fast path for pure ASCII but also
    folds other scripts, so it is used only where every byte is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, ASCII_UPPER, ASCII_LOWER))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two XXH64 chains with different seeds
    (the leading literal seeds the second)."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def map_texts(docs: DataFrame, carried: Sequence[str], make, added: str) -> DataFrame:
    """``carried`` columns of every row and the ``added`` ones (a schema string).

    ``make()(texts)`` gives, for the list of a batch's texts, a list of values
    for each added column.  Carried columns stay Arrow arrays: pandas would
    turn integers beside a null into floats, which are inexact beyond 2^53.
    """
    new = StructType.fromDDL(added)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        values = make()
        types = [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            more = [pa.array(v, t) for v, t in zip(values(batch.column(len(carried)).to_pylist()), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], *more], names=[*carried, *new.names])

    schema = StructType([docs.schema[c] for c in carried] + new.fields)
    return docs.select(*carried, F.col("text").alias("_text")).mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """A broadcast hint for ``df`` if its measured size allows it.

    ``df`` is read once for its size, so it should be a written table.  The
    join is the same either way; beyond the bound it is a shuffle join.
    """
    size = F.lit(16)
    for field in df.schema.fields:
        text = field.dataType.simpleString() == "string"
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)) if text else
                       F.coalesce(F.size(field.name), F.lit(0)) * 24 if field.dataType.typeName() == "array" else
                       F.lit(8))
    total = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df
