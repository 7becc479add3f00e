"""Triple filters and projections (F1-F5, P1-P4): plain ``where`` / ``select``.

They sit directly on the scan, so Catalyst evaluates them before any
shuffle and prunes the columns nothing downstream reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgprep.schema import BLANK, LITERAL, URI


def literal_object(df: DataFrame) -> DataFrame:
    """triples whose object is a literal."""
    return df.where(F.col("o_kind") == LITERAL)


def uri_subject(df: DataFrame) -> DataFrame:
    """triples whose subject is a URI."""
    return df.where(F.col("s_kind") == URI)


def literal_triples(df: DataFrame) -> DataFrame:
    """URI subject and literal object (drops blank subjects)."""
    return df.where((F.col("s_kind") == URI) & (F.col("o_kind") == LITERAL))


def uri_triples(df: DataFrame) -> DataFrame:
    """subject and object both URIs."""
    return df.where((F.col("s_kind") == URI) & (F.col("o_kind") == URI))


def blank_triples(df: DataFrame) -> DataFrame:
    """triples with a blank subject or a blank object, distinct."""
    return df.where((F.col("s_kind") == BLANK) | (F.col("o_kind") == BLANK)).distinct()


def subjects(df: DataFrame) -> DataFrame:
    """Subject nodes."""
    return df.select(F.col("s").alias("node"), F.col("s_kind").alias("kind"))


def objects(df: DataFrame) -> DataFrame:
    """Object nodes."""
    return df.select(F.col("o").alias("node"), F.col("o_kind").alias("kind"))


def predicates(df: DataFrame) -> DataFrame:
    """Predicate nodes (always URIs)."""
    return df.select(F.col("p").alias("node"), F.lit(URI).alias("kind"))


def as_spo(df: DataFrame) -> DataFrame:
    """The (s, p, o) tuple."""
    return df.select("s", "p", "o")


def drop_language(df: DataFrame, col: str = "language") -> DataFrame:
    """P3."""
    return df.drop(col)


def language_rows(df: DataFrame, languages: str | Sequence[str], col: str = "language") -> DataFrame:
    """Rows of one language or of a language list (by value, not position)."""
    langs = [languages] if isinstance(languages, str) else list(languages)
    return df.where(F.col(col).isin(langs))


def quads_from_triples(df: DataFrame, language_col: str = "language") -> DataFrame:
    """The 4-column (s, p, o, language) layout from language-tagged URI triples."""
    return uri_triples(df).select("s", "p", "o", F.col(language_col).alias("language"))
