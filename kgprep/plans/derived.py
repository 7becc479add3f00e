"""RDF inputs derived from the driver's tables (customer, nation, region,
orders, lineitem, documents).  Every query reads whole tables; the text,
ids and splits below grow with them.

Base URI ``http://example.org/``:

* URI triples: customer/K -nation-> nation/N, nation/N -region-> region/R,
  order/O -customer-> customer/K
* literal triples: customer/K -name-> "c_name"@en,
  order/O -date-> "yyyy-MM-dd"^^xsd:date
* blank triples: _:l<orderkey>_<line> -order-> order/O and order/O -line-> _:l...
* quads: doc/<lang>/<doc_id> -source-> source/<lang>/<source>, language = lang
* star links: source/<lang>/<source> sameAs the same source in the next
  language (alphabetical) that holds it
* chain links: order/O sameAs the customer's next order (by o_orderkey)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgprep.functions.nodes import nt_line
from kgprep.schema import BLANK, LITERAL, OWL_SAME_AS, URI, XSD_DATE

BASE = "http://example.org/"
SEED = "42"
NEXT_BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def uri(kind: str, col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(f"{BASE}{kind}/"), c.cast("string"))


def _triple(s: Column, s_kind: str, p: str, o: Column, o_kind: str, lang: str | None = None,
            datatype: str | None = None) -> list[Column]:
    return [s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(BASE + p).alias("p"), o.alias("o"),
            F.lit(o_kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"),
            F.lit(datatype).cast("string").alias("o_datatype")]


def uri_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders")
    return (c.select(*_triple(uri("customer", "c_custkey"), URI, "nation", uri("nation", "c_nationkey"), URI))
            .unionByName(n.select(*_triple(uri("nation", "n_nationkey"), URI, "region",
                                           uri("region", "n_regionkey"), URI)))
            .unionByName(o.select(*_triple(uri("order", "o_orderkey"), URI, "customer",
                                           uri("customer", "o_custkey"), URI))))


def literal_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    return (c.select(*_triple(uri("customer", "c_custkey"), URI, "name", F.col("c_name"), LITERAL, lang="en"))
            .unionByName(o.select(*_triple(uri("order", "o_orderkey"), URI, "date",
                                           F.date_format("o_orderdate", "yyyy-MM-dd"), LITERAL,
                                           datatype=XSD_DATE))))


def blank_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    label = F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string"), F.lit("_"),
                     F.col("l_linenumber").cast("string"))
    return (li.select(*_triple(label, BLANK, "order", uri("order", "l_orderkey"), URI))
            .unionByName(li.select(*_triple(uri("order", "l_orderkey"), URI, "line", label, BLANK))))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived triples in the TRIPLE layout."""
    return (uri_triples(spark, sf_dir).unionByName(literal_triples(spark, sf_dir))
            .unionByName(blank_triples(spark, sf_dir)))


def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph rendered as N-Triples text (``value`` column)."""
    return graph(spark, sf_dir).select(nt_line().alias("value"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit(BASE + "doc/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("s"),
                    F.lit(BASE + "source").alias("p"),
                    F.concat(F.lit(BASE + "source/"), F.col("lang"), F.lit("/"), F.col("source")).alias("o"),
                    F.col("lang").alias("language"))


def star_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, its entity in one language sameAs its entity in the next.

    The window runs over the distinct (source, language) table, at most
    #languages rows per source.
    """
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    w = Window.partitionBy("source").orderBy("lang")
    pairs = d.withColumn("next", F.lead("lang").over(w)).where(F.col("next").isNotNull())
    return pairs.select(F.concat(F.lit(BASE + "source/"), F.col("lang"), F.lit("/"), F.col("source")).alias("s"),
                        F.lit(OWL_SAME_AS).alias("p"),
                        F.concat(F.lit(BASE + "source/"), F.col("next"), F.lit("/"), F.col("source")).alias("o"))


def next_in_group(df: DataFrame, key: str, t: str, block: int = NEXT_BLOCK) -> DataFrame:
    """Adds ``next``: the following ``t`` within ``key`` (null for the last).

    Windows are per ``(key, block of t)``, so a key holding a third of all
    rows is still cut into bounded window partitions; the hand-over between
    blocks comes from the per-key block table (one row per non-empty block).
    """
    blk = F.floor(F.col(t) / block)
    x = df.withColumn("_blk", blk)
    inner = x.withColumn("_nx", F.lead(t).over(Window.partitionBy(key, "_blk").orderBy(t)))
    firsts = x.groupBy(key, "_blk").agg(F.min(t).alias("_first"))
    handover = firsts.select(key, "_blk", F.lead("_first").over(Window.partitionBy(key).orderBy("_blk")).alias("_nb"))
    return (inner.join(handover, [key, "_blk"])
            .withColumn("next", F.coalesce("_nx", "_nb")).drop("_blk", "_nx", "_nb"))


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of one customer; ``seq`` (the subject's order key)
    is the processing order of the ordered fold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nx = next_in_group(o, "o_custkey", "o_orderkey").where(F.col("next").isNotNull())
    return nx.select(uri("order", "o_orderkey").alias("s"), F.lit(OWL_SAME_AS).alias("p"),
                     uri("order", "next").alias("o"), F.col("o_orderkey").alias("seq"))
