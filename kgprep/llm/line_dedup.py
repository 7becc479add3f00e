"""Line dedup: a line that several documents hold stays only in the first of them.

Lines are exploded with their position and hashed by their normalised form;
per hash the distinct documents are counted (smallest and largest id, so the
count is a hash aggregate that combines before the shuffle).  Lines over the
threshold are dropped by position, and each document is put together again
from the positions it keeps.

Only hashes, ids and positions are shuffled, never the lines.  Hashes that
hold more than ``HEAVY_SHARE`` of all lines are at most 1/``HEAVY_SHARE``
many; they are joined by broadcast, and their lines are spread evenly
over the shuffle that joins the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgprep.llm.common import ascii_lower, text_key, written

SPACE = " \t\n\x0b\f\r"
HEAVY_SHARE = 1e-4


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def repeated_lines(lines: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Hashes found in several documents: h1, h2, keep (smallest doc_id), heavy.

    Null ids together count as one document, which comes after all others.
    """
    per_hash = lines.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("keep"), F.max("doc_id").alias("_last"),
        F.max(F.col("doc_id").isNull()).alias("_null"), F.count(F.lit(1)).alias("_n"))
    several = (F.col("keep") != F.col("_last")) | (F.col("_null") & F.col("keep").isNotNull())
    kept = written(per_hash.where(several).select("h1", "h2", "keep", "_n"), "lines")
    total = kept.agg(F.sum("_n")).first()[0] or 0
    return kept.select("h1", "h2", "keep", (F.col("_n") > max(1.0, total * heavy_share)).alias("heavy"))


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines (h1, h2, doc_id, ..., pos) that lose to an earlier document."""
    heavy = repeated.where("heavy").select("h1", "h2", F.col("keep").alias("_hot_keep"), F.lit(True).alias("_hot"))
    light = repeated.where(~F.col("heavy")).select(
        F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), F.lit(False).alias("_k3"), "keep",
        F.lit(True).alias("_found"))
    # at most 1 / HEAVY_SHARE rows by construction
    rows = lines.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    rows = rows.select("*", F.when(F.col("_hot"), F.xxhash64("t1", "pos")).otherwise(F.col("h1")).alias("_k1"),
                       F.col("h2").alias("_k2"), F.col("_hot").alias("_k3"))
    rows = rows.join(light, ["_k1", "_k2", "_k3"], "left")
    keep = F.coalesce("_hot_keep", "keep")
    lost = (F.col("_hot") | F.col("_found")) & ~F.col("doc_id").eqNullSafe(keep)
    return rows.where(lost).select("doc_id", "t1", "t2", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A null or empty text is one empty line.  Rows with the same doc_id are
    one document when documents are counted, and each keeps its own lines;
    rows repeated exactly lose the same lines.  Columns of ``docs`` other
    than doc_id and text are carried through; names that clash with the
    added columns are replaced.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    carried = [c for c in docs.columns if c not in (*added, "doc_id", "text")]
    base = docs.select(F.struct(*carried).alias("_rest") if carried else F.lit(None).alias("_rest"),
                       "doc_id", "text", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    t1, t2 = text_key(F.col("_text"))
    base = base.select("*", t1.alias("t1"), t2.alias("t2"))
    # keys are made inside the generator, so that the filter and both hashes share them
    keys = F.transform(F.split("_text", "\n"), line_key)
    lines = base.select("doc_id", "t1", "t2", F.posexplode(keys).alias("pos", "_key"))
    h1, h2 = text_key(F.col("_key"))
    lines = written(lines.where(F.char_length("_key") >= min_chars)
                    .select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2")), "hashes")
    lost = dropped_positions(lines, repeated_lines(lines))
    # rows repeated exactly yield the same positions again: a set, not a list
    lost = lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("_lost"))
    lost = lost.select(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_lost")
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t1"))
                       & (F.col("t2") == F.col("_t2")), "left")
    parts = F.split("_text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_lost"))
    whole = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    out = joined.select(*[F.col("_rest")[c].alias(c) for c in carried], "doc_id", "text",
                        F.size(parts).cast("bigint").alias("n_lines"),
                        F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
                        whole.alias("kept_text"))
    return out.select(*docs.drop(*added).columns, *added)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document row."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
