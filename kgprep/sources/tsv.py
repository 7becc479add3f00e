"""Headerless TSV scans (S6-S8): dictionaries, language-tagged triples, links.

Inputs are directories of part files; only ``*.bz2`` parts are read (the
filter is a glob on the file name), empty parts contribute no rows, and CSV
quoting is off so a ``"`` inside a URI is plain data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgprep.functions.nodes import unescape
from kgprep.schema import LINK, QUAD


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = "*.bz2",
             mode: str = "FAILFAST") -> DataFrame:
    reader = (spark.read.schema(schema).option("sep", "\t").option("header", "false")
              .option("quote", "").option("escape", "").option("comment", "")
              .option("mode", mode).option("encoding", "UTF-8"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def read_dictionary(spark: SparkSession, path: str, key: str = "entity", glob: str | None = "*.bz2") -> DataFrame:
    """``key STRING, id BIGINT`` parts of an entity or relation dictionary."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("id", T.LongType())])
    return read_tsv(spark, path, schema, glob)


def read_quads(spark: SparkSession, path: str, glob: str | None = "*.bz2") -> DataFrame:
    """``s, p, o, language`` triples."""
    return read_tsv(spark, path, QUAD, glob)


def read_links(spark: SparkSession, path: str, glob: str | None = "*.bz2") -> DataFrame:
    """``s, p, o`` sameAs links."""
    return read_tsv(spark, path, LINK, glob)


def read_tuples(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tuple text ``(a,b[,c])`` (the K1 layout) back into typed columns.

    Only the first field may contain commas (URIs do), so the line is split
    on its last ``n - 1`` commas; the other fields are cast to the schema.
    A line that does not fit raises.
    """
    n = len(schema.fields)
    pattern = r"(?s)^\((.*)" + r",([^,]*)" * (n - 1) + r"\)$"
    groups = "\n".join(f"${i + 1}" for i in range(n))
    # one regex pass; a newline cannot be inside a line, so it separates the groups
    fields = F.split(F.regexp_replace(F.col("value"), pattern, groups), "\n")
    fields = F.when(F.size(fields) == n, fields).otherwise(F.raise_error(F.concat(
        F.lit("malformed tuple line: "), F.col("value"))).cast("array<string>"))
    rows = spark.read.text(path).select(fields.alias("_f"))
    return rows.select(*[F.get("_f", i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_literal_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Encoded literal triples ``(s,p,literal)`` (K1 layout of J5): s and p ids, and
    the literal's ``o``, ``o_lang`` and ``o_datatype``.

    The ids hold no commas, so the literal is all behind the second one.  A
    line that does not fit raises.
    """
    pattern = r'(?s)^\((\d+),(\d+),"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]++)|\^\^(.*))?\)$'
    fields = F.split(F.regexp_replace(F.col("value"), pattern, "$1\n$2\n$3\n$4\n$5"), "\n")
    fields = F.when(F.size(fields) == 5, fields).otherwise(F.raise_error(F.concat(
        F.lit("malformed literal mapping: "), F.col("value"))).cast("array<string>"))
    f = spark.read.text(path).select(fields.alias("_f"))
    return f.select(F.get("_f", 0).cast("long").alias("s"), F.get("_f", 1).cast("long").alias("p"),
                    unescape(F.get("_f", 2)).alias("o"), F.nullif(F.get("_f", 3), F.lit("")).alias("o_lang"),
                    F.nullif(F.get("_f", 4), F.lit("")).alias("o_datatype"))
