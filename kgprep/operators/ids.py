"""Dictionaries: distinct entities / relations and dense ids.

Dense ids (D3) without a single-partition sort.  Each key gets
``h = md5(key)``; a bucket is the first ``k`` hex digits of ``h``.  A running
sum over the bucket table (at most 16^k rows per scope) gives each bucket's
offset.  It has two levels, so that no task holds the table: sums by the first
``TOP_DIGITS`` digits are added up in order, then those inside each of these.  Inside a bucket
``row_number`` ordered by ``(h, key)`` finishes the id.  The result equals
``row_number() over (partition by scope order by md5(key), key) - 1``: a
pure function of the data, stable under recomputation, retries, any
partitioning and any ``k``, and buckets are uniform by construction, so no
task gets a hot bucket.  ``k`` follows the shuffle partitions of the
session, so there are always several buckets for each task.  A null scope is
a scope of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.schema import URI
from kgprep.session import checkpoint_dir

MIN_BUCKET_DIGITS, MAX_BUCKET_DIGITS = 4, 7
TOP_DIGITS = 2


def bucket_digits_for(df: DataFrame) -> int:
    """Hex digits that give at least 16 buckets for each shuffle partition (65,536 buckets or more)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKET_DIGITS, max(MIN_BUCKET_DIGITS, math.ceil(math.log(max(1, parts) * 16, 16))))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys appear once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _scope_list(scope: str | Sequence[str] | None) -> list[str]:
    if scope is None:
        return []
    return [scope] if isinstance(scope, str) else list(scope)


def _is_uri(df: DataFrame, kind_col: str) -> Column:
    return F.col(kind_col) == URI if kind_col in df.columns else F.lit(True)


def entities(df: DataFrame, scope: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct URI subjects and URI objects over all triples, one scan.

    ``explode(array(s, o))`` instead of a union of two projections, then a
    distinct whose partial aggregation runs map-side (a hot entity costs one
    row per map task in the shuffle).
    """
    sc = _scope_list(scope)
    nodes = F.explode(F.array(F.when(_is_uri(df, "s_kind"), F.col("s")),
                              F.when(_is_uri(df, "o_kind"), F.col("o"))))
    return (df.select(*sc, nodes.alias("entity"))
            .where(F.col("entity").isNotNull()).distinct())


def relations(df: DataFrame, scope: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct predicates."""
    sc = _scope_list(scope)
    return df.select(*sc, F.col("p").alias("relation")).where(F.col("relation").isNotNull()).distinct()


def bucket_offsets(buckets: DataFrame, scope: Sequence[str], count: str, total: str | None = None) -> DataFrame:
    """``(scope, _b, _off)`` of a table of bucket counts: the rows in all buckets before ``_b``, in two levels.

    ``total`` names a column for the rows of the whole scope.
    """
    def before(keys, order):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    sc, zero = list(scope), F.lit(0)
    buckets = buckets.withColumn("_t", F.substring("_b", 1, TOP_DIGITS))
    top = buckets.groupBy(*sc, "_t").agg(F.sum(count).alias("_tn"))
    whole = [F.sum("_tn").over(Window.partitionBy(*sc)).alias(total)] if total else []
    top = top.select(*sc, "_t", F.coalesce(F.sum("_tn").over(before(sc, "_t")), zero).alias("_toff"), *whole)
    inner = buckets.withColumn("_ioff", F.coalesce(F.sum(count).over(before([*sc, "_t"], "_b")), zero))
    return join_null_safe(inner, top, [*sc, "_t"]).select(
        *sc, "_b", (F.col("_toff") + F.col("_ioff")).alias("_off"), *([total] if total else []))


def dense_ids(keys: DataFrame, key: str, scope: str | Sequence[str] | None = None, id_col: str = "id",
              bucket_digits: int | None = None) -> DataFrame:
    """D3: ids 0..n-1 (per scope) for a DataFrame of distinct keys; a null key gets none."""
    sc = _scope_list(scope)
    digits = bucket_digits or bucket_digits_for(keys)
    h = F.md5(F.col(key).cast("string"))
    keyed = keys.where(F.col(key).isNotNull()).select(*sc, F.col(key), h.alias("_h"),
                                                      F.substring(h, 1, digits).alias("_b"))
    # Bucket counts combine map-side, so only the ranking branch shuffles
    # and sorts the keys; the exchange of the distinct keys feeds both.
    counts = keyed.groupBy(*sc, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = bucket_offsets(counts, sc, "_n")
    inside = Window.partitionBy(*sc, "_b").orderBy("_h", key)
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    # left join: every bucket has an offset.  A bucket is never null: without a scope it is joined as it
    # is, so the ranked keys stay where the window has put them.
    placed = join_null_safe(ranked, offsets, [*sc, "_b"]) if sc else ranked.join(offsets, "_b", "left")
    return (placed.select(*sc, key, (F.col("_off") + F.col("_r") - 1).cast("long").alias(id_col)))


def entity_dictionary(df: DataFrame, scope: str | Sequence[str] | None = None, **kw) -> DataFrame:
    """``(entity, id)``; with ``scope`` ids are dense per scope value."""
    return dense_ids(entities(df, scope), "entity", scope, **kw)


def relation_dictionary(df: DataFrame, scope: str | Sequence[str] | None = None, **kw) -> DataFrame:
    """``(relation, id)``."""
    return dense_ids(relations(df, scope), "relation", scope, **kw)


def as_lookup(dictionary: DataFrame, key: str = "entity", scope: str | Sequence[str] | None = None,
              stored: bool = False) -> DataFrame:
    """One id per key; a repeated key keeps its largest id.

    ``stored`` checkpoints the result: joins then read it rather than
    aggregate it on their own key, which would keep AQE from splitting a hot key.
    """
    sc = _scope_list(scope)
    out = dictionary.groupBy(*sc, key).agg(F.max("id").alias("id"))
    if stored:
        checkpoint_dir(dictionary.sparkSession)
        out = out.checkpoint()
    return out


def sorted_by_id(dictionary: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned on id and sorted inside each partition, so the
    part files concatenate in id order without a single-task sort."""
    parts = [partitions] if partitions else []
    return dictionary.repartitionByRange(*parts, "id").sortWithinPartitions("id")


def append_relation(dictionary: DataFrame, uri: str, key: str = "relation", check_dense: bool = True) -> DataFrame:
    """Add one relation whose id is the dictionary's row count; one that is there already keeps its id.

    The new id is only meaningful for a dense dictionary (ids 0..n-1); with
    ``check_dense`` a non-dense input raises at run time.
    """
    stats = dictionary.agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_max"),
                           F.max((F.col(key) == F.lit(uri)).cast("int")).alias("_known"))
    new_id = F.col("_n")
    if check_dense:
        new_id = F.when((F.col("_n") == 0) | (F.col("_max") == F.col("_n") - 1), F.col("_n")).otherwise(
            F.raise_error(F.lit("append_relation needs a dense dictionary (ids 0..n-1)")))
    extra = (stats.where(F.coalesce("_known", F.lit(0)) == 0)
             .select(F.lit(uri).alias(key), new_id.cast("long").alias("id")))
    return dictionary.select(key, "id").unionByName(extra)


def grow_dictionary(known: DataFrame, keys: DataFrame, key: str = "entity", scope: str | Sequence[str] | None = None,
                    check_dense: bool = True) -> DataFrame:
    """D3-D6 for data that arrives in batches: ``known`` and the new ones of ``keys`` with the next ids.

    Old ids stay.  Keys that ``known`` lacks get dense ids among themselves, after the
    ids of their scope, so the result is dense again and a pure function of the batches and
    their order.  Only new keys are ranked; the known ones are met by one anti-join, which AQE splits if
    ``known`` is stored.  Repeated and null keys in a batch are harmless.  With ``check_dense`` a dictionary
    whose ids are not 0..n-1 raises when it runs.
    """
    sc = _scope_list(scope)
    fresh = keys.select(*sc, key).where(F.col(key).isNotNull()).distinct()
    side = known.select(*sc, key).withColumnsRenamed({c: f"_r_{c}" for c in [*sc, key]})
    on = F.col(key) == F.col(f"_r_{key}")
    for c in sc:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    fresh = dense_ids(fresh.join(side, on, "left_anti"), key, scope)
    size = known.groupBy(*sc).agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_max"))
    start = F.col("_n")
    if check_dense:
        start = F.when(F.coalesce("_max", F.lit(-1)) == F.col("_n") - 1, F.col("_n")).otherwise(
            F.raise_error(F.lit("grow_dictionary needs a dense dictionary (ids 0..n-1)")).cast("long"))
    size = size.select(*sc, start.alias("_start"))
    if sc:
        fresh = join_null_safe(fresh, size, sc)
    else:
        fresh = fresh.join(F.broadcast(size))  # one row
    fresh = fresh.select(*sc, key, (F.col("id") + F.coalesce("_start", F.lit(0))).alias("id"))
    return known.select(*sc, key, "id").unionByName(fresh)
