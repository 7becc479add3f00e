"""N-Triples scan with a side table of malformed lines.

The files are read and parsed once.  Every line becomes one stored row: a
triple, a rejected line or a skipped one (empty or comment), so the counts
of the three add up to the lines of the input.

A line's number in its file needs no sort and no single task: lines of one
split are read in order by one task, which numbers them; the numbers at which
splits begin are running sums over one row for each split.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgprep.functions.nodes import OBJECT_START, PREDICATE_START, SUBJECT_START, split_statement
from kgprep.session import scratch_path
from kgprep.sources.ntriples import CORRUPT, PERMISSIVE, TRIPLE_COLUMNS, parse_ntriples


class Quarantined(NamedTuple):
    triples: DataFrame  # TRIPLE layout
    rejected: DataFrame  # file, row (from 1), line, reason
    counts: DataFrame  # file, lines, triples, rejected, skipped


def reject_reason(line: Column | str) -> Column:
    """The first part of a malformed line that N-Triples does not allow: ``subject``,
    ``predicate``, ``object``, ``end`` (no final dot, or text behind it) or ``escape``."""
    t = F.col(line) if isinstance(line, str) else line
    return (F.when(F.size(split_statement(t)) == 3, F.lit("escape"))
            .when(~t.rlike(SUBJECT_START), F.lit("subject"))
            .when(~t.rlike(PREDICATE_START), F.lit("predicate"))
            .when(~t.rlike(OBJECT_START), F.lit("object"))
            .otherwise(F.lit("end")))


def read_with_quarantine(spark: SparkSession, paths: str | Iterable[str], scope_blank_nodes: bool = True,
                         store: str | None = None) -> Quarantined:
    """Scan files (plain or ``.bz2``; globs allowed): triples, malformed lines and counts by file.

    The parsed rows are stored as Parquet in ``store`` (by default a new path in
    the shared folder).  A file without lines has no row in the counts.
    """
    raw = spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    parsed = parse_ntriples(raw, mode=PERMISSIVE, keep=("file", "block", "at"), keep_skipped=True,
                            blank_scope=F.col("file") if scope_blank_nodes else None)
    path = store or scratch_path(spark, "parsed-lines")
    parsed.write.parquet(path)
    rows = spark.read.schema(parsed.schema).parquet(path)
    bad = F.col(CORRUPT).isNotNull()

    # a split is read by one task, in order: its lines are numbered from its least ``at``
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rejected = rows.where(bad).select("file", "block", "at", F.col(CORRUPT).alias("line"))
    rejected = rejected.join(blocks, ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("row"), "line",
        reject_reason("line").alias("reason"))
    count_of = {"triples": F.col("s").isNotNull(), "rejected": bad, "skipped": F.col("s").isNull() & ~bad}
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), *[
        F.count_if(test).alias(name) for name, test in count_of.items()])
    return Quarantined(rows.where("s IS NOT NULL").select(TRIPLE_COLUMNS), rejected, counts)
