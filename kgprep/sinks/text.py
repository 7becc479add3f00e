"""Text sinks (K1-K5).  Every writer writes parts in parallel; none funnels
the data through one task.  Where a single logical file matters (counted
files, id order) the parts are range-partitioned so that concatenating them
in name order gives the intended file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgprep.functions.nodes import compact, readable_node

# Block size of bzip2 files in 100 kB.  Small blocks stay in a core's cache: on N-Triples about as small as
# with 9, and several times as fast to write and to read.
BZIP2_LEVEL = 1


def _fields(cols: Sequence[str], sep: str) -> Column:
    """Fields joined by ``sep``; a null is an empty field, so columns never shift."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def tuple_text(cols: Sequence[str]) -> Column:
    """``(a,b,c)``: the tuple layout of the dictionary and mapping files (null: empty field)."""
    return F.concat(F.lit("("), _fields(cols, ","), F.lit(")"))


def tsv_text(cols: Sequence[str]) -> Column:
    """Tab-joined fields, no quoting (URIs never hold tabs or newlines; null: empty field)."""
    return _fields(cols, "\t")


def readable_text(df: DataFrame) -> Column:
    """``s @p o`` with rdf: and dc: compacted (TRIPLE layout input)."""
    return F.concat_ws(" ", readable_node("s", "s_kind"), F.concat(F.lit("@"), compact(F.col("p"))),
                       readable_node("o", "o_kind", "o_lang", "o_datatype"))


def _write_lines(lines: DataFrame, path: str, mode: str, compression: str | None, file_lines: int | None = None) -> None:
    """``file_lines`` starts a new file after so many lines: a codec that cannot be split is then still read in parallel."""
    w = lines.write.mode(mode)
    if file_lines:
        w = w.option("maxRecordsPerFile", file_lines)
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def write_bzip2(lines: DataFrame, path: str) -> None:
    """The ``value`` lines as ``part-*.txt.bz2`` below the new folder ``path``, one part for each partition, in order.

    Spark's bzip2 writer is Hadoop's Java codec, always with blocks of 900 kB.  Where the folder is one that
    all machines mount (``file:``), the tasks compress with libbz2 instead, in blocks of ``BZIP2_LEVEL`` x 100 kB;
    in any other store Spark's writer is used.  A part gets its name when it is whole, and the same one in every
    attempt of its task, so an attempt that dies leaves nothing that ``*.bz2`` matches.
    """
    sc = lines.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(where):
        raise FileExistsError(path)
    uri = fs.makeQualified(where).toUri()
    if uri.getScheme() != "file":
        _write_lines(lines, path, "errorifexists", "bzip2")
        return
    fs.mkdirs(where)
    folder, level = uri.getPath(), BZIP2_LEVEL

    def compress(batches):
        import bz2
        import os

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"{folder}/part-{task.partitionId():05d}.txt.bz2"
        begun, n, packer = f"{folder}/_{task.taskAttemptId()}.begun", 0, bz2.BZ2Compressor(level)
        with open(begun, "wb") as f:
            for batch in batches:
                if batch.num_rows:
                    n += batch.num_rows
                    text = pc.binary_join(pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0)), "\n")
                    f.write(packer.compress(text[0].as_buffer()))
                    f.write(packer.compress(b"\n"))
            f.write(packer.flush())
        os.replace(begun, part) if n else os.remove(begun)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # a null is an empty line, as in Spark's writer
    text = lines.select(F.coalesce("value", F.lit("")).alias("value"))
    if not text.mapInArrow(compress, "n long").agg(F.sum("n")).first()[0]:
        _write_lines(text.limit(0), path, "append", "bzip2")  # a file without lines, so that the folder can be read


def _ordered(df: DataFrame, order_by: Sequence[str] | None) -> DataFrame:
    """D8 as a sink option: range-partitioned and sorted inside each part,
    so the parts concatenate in key order (no single-task sort)."""
    return df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df


def write_tuples(df: DataFrame, path: str, cols: Sequence[str] | None = None, mode: str = "overwrite",
                 compression: str | None = None, order_by: Sequence[str] | None = None) -> None:
    """K1: one ``(a,b[,c])`` line per row."""
    _write_lines(_ordered(df, order_by).select(tuple_text(cols or df.columns).alias("value")), path, mode,
                 compression)


def write_tsv(df: DataFrame, path: str, cols: Sequence[str] | None = None, mode: str = "overwrite",
              compression: str | None = None, order_by: Sequence[str] | None = None) -> None:
    """K2: headerless TSV, overwrite."""
    _write_lines(_ordered(df, order_by).select(tsv_text(cols or df.columns).alias("value")), path, mode,
                 compression)


def counted_lines(df: DataFrame, cols: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """K3 plan: the row count line first, then one TSV line per row.

    The count is a one-partition global aggregate placed *before* the data
    in a union, whose partitions keep child order, so it is written as the
    first part file and the data parts follow without any extra shuffle (a
    hot group of identical rows stays spread over its tasks).  With
    ``order_by`` (e.g. ``id`` for dictionaries) the data is range
    partitioned and sorted within parts, so the parts concatenate in order.
    """
    cols = list(cols or df.columns)
    data = df
    if order_by:
        parts = [partitions] if partitions else []
        data = data.repartitionByRange(*parts, *order_by).sortWithinPartitions(*order_by)
    head = df.agg(F.count(F.lit(1)).cast("string").alias("value"))
    return head.union(data.select(tsv_text(cols).alias("value")))


def write_counted(df: DataFrame, path: str, cols: Sequence[str] | None = None,
                  order_by: Sequence[str] | None = None, mode: str = "overwrite",
                  compression: str | None = None) -> None:
    """K3: like ``write_tsv`` with the row count as the first line.

    The input feeds both the count and the lines, so it is persisted
    (memory and disk) for the duration of the write instead of being
    computed twice; a frame that the caller has cached stays cached.
    """
    was_cached = df.storageLevel.useMemory or df.storageLevel.useDisk
    cached = df if was_cached else df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _write_lines(counted_lines(cached, cols, order_by), path, mode, compression)
    finally:
        if not was_cached:
            cached.unpersist()


def write_readable(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """K4: readable triples ``s @p o``."""
    _write_lines(df.select(readable_text(df).alias("value")), path, mode, compression)


def write_language_outputs(df: DataFrame, path: str, layout: str = "tuple", cols: Sequence[str] | None = None,
                           partition_cols: Sequence[str] = ("language", "dataset"),
                           mode: str = "overwrite", compression: str | None = None) -> None:
    """K5: one directory per ``language=…/dataset=…`` written by one job.

    The layout stays partition-pruned when read back.
    """
    pcols = [c for c in partition_cols if c in df.columns]
    data_cols = [c for c in (cols or df.columns) if c not in pcols]
    text = tuple_text(data_cols) if layout == "tuple" else tsv_text(data_cols)
    # Rows of a value are brought together, so a value has few files; the
    # adaptive rebalance splits a value that holds more than a task's share.
    lines = df.select(*pcols, text.alias("value")).hint("rebalance", *pcols).sortWithinPartitions(*pcols)
    w = lines.write.mode(mode).partitionBy(*pcols)
    if compression:
        w = w.option("compression", compression)
    w.text(path)
