"""Corpus pipeline: ``documents`` to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``; ``n_chars``, where there is one,
follows the text.  Columns other than doc_id and text go through a stage as
one struct, so they keep their values whatever their names.  Rows without an id, null texts, repeated rows and empty
tables go through each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgprep.llm.common import table, written
from kgprep.llm.decontamination import decontaminate
from kgprep.llm.line_dedup import dedup_lines
from kgprep.llm.packing import pack_documents
from kgprep.llm.simhash_dedup import first_of_each_group
from kgprep.llm.toxicity import score_documents


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and row, a struct of all other columns, whose names then clash with nothing."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(0).alias("none")]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` that ``packed`` put together."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    scored = score_documents(packed(docs), table(spark, sf_dir, "labels"))
    return unpacked(scored.where("predicted = 0"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are taken out of the text."""
    out = dedup_lines(packed(docs))
    changed = F.col("n_dropped") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("row", F.when(changed, F.col("row").withField("n_chars", n_chars)).otherwise(F.col("row")))
    return unpacked(out, docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return unpacked(first_of_each_group(packed(docs)), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much benchmark text go."""
    out = decontaminate(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(out.where(~F.col("contaminated")), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised, cut and packed: one row per piece, with its sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# A classifier, connected components and a tokenizer are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
