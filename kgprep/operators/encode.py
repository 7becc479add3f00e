"""Encoding joins (J1-J8): URIs to ids by equi-joins against dictionaries.

Entity lookups are shuffle joins (both sides grow with the data); AQE
splits a skewed join partition (e.g. one class URI that is the object of a
third of all triples) into several tasks by map-output blocks, replicating
the single matching dictionary row.  It can do so if the dictionary is read or
checkpointed, not aggregated on the join key in the same plan
(``as_lookup(..., stored=True)``).  ``skew_share`` splits hot keys without
AQE.  The relation dictionary is broadcast only after its bytes are checked
(``bounded_broadcast``); above the bound it is joined like the entities.
A null scope is a scope of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgprep.operators.ids import _scope_list, join_null_safe
from kgprep.session import checkpoint_dir

MAX_BROADCAST_BYTES = 64 << 20
MIN_SKEW_SHARE = 1e-5  # at most 100,000 heavy keys for each column


def _stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it is cached, else a checkpoint, which goes away with its last reference."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the side is proven small.

    The side is stored and measured first (a relation dictionary is a
    distinct over one column, so this costs one scan with map-side partial
    aggregation).  Within ``max_bytes`` the big side is never shuffled for
    this join.  A join planned as a shuffle and converted by AQE at run time
    would already have written the big side's shuffle.
    """
    side = _stored(df)
    row = F.lit(0)
    for name, kind in side.dtypes:
        row = row + (F.coalesce(F.octet_length(name), F.lit(0)) + 8 if kind == "string" else F.lit(8))
    size = side.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(side) if size <= max_bytes else side


def _entity_side(ent: DataFrame, col: str, sc: list[str]) -> DataFrame:
    return ent.select(*sc, F.col("entity").alias(col), F.col("id").alias(f"_{col}_id"))


def heavy_keys(df: DataFrame, cols: Sequence[str], min_share: float, scope: Sequence[str] = ()) -> dict[str, DataFrame]:
    """For each of ``cols`` the values (with their scope) held by at least
    ``min_share`` of the rows: at most ``1 / min_share`` of them.

    One aggregate over one projection counts all columns, with map-side partial aggregation.
    """
    if not MIN_SKEW_SHARE <= min_share <= 1:
        raise ValueError(f"skew_share must be between {MIN_SKEW_SHARE} and 1, not {min_share}")
    sc = list(scope)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_key")) for c in cols]))
    counts = df.select(*sc, cells.alias("_x")).groupBy(*sc, "_x").agg(F.count(F.lit(1)).alias("_n"))
    counts = _stored(counts.select(*sc, "_x.*", "_n"))
    total = counts.where(F.col("_col") == cols[0]).agg(F.sum("_n")).first()[0] or 0
    threshold = max(1, math.ceil(min_share * total))
    heavy = _stored(counts.where((F.col("_n") >= threshold) & F.col("_key").isNotNull()).drop("_n"))
    return {c: heavy.where(F.col("_col") == c).select(*sc, F.col("_key").alias(c)) for c in cols}


def _scoped_join(x: DataFrame, side: DataFrame, sc: list[str], col: str, how: str) -> DataFrame:
    """Equi-join on a node column, and null-safe on the scope."""
    if not sc:
        return x.join(side, col, how)
    return join_null_safe(x, side, [*sc, col], how)


def _lookup_join(x: DataFrame, side: DataFrame, sc: list[str], col: str, how: str, hot: DataFrame | None) -> DataFrame:
    """Join of the data ``x`` with a dictionary side on scope and ``col``.

    The rows of ``hot`` keys meet the matching dictionary rows in a broadcast
    join, with no shuffle, if these are small, and only the remaining rows are shuffle-joined,
    so no join task receives a hot key.  Without ``hot``, AQE splits skewed
    partitions at run time.
    """
    if hot is None:
        return _scoped_join(x, side, sc, col, how)
    # a bounded number of keys, but of any length: their bytes are checked too
    hot = bounded_broadcast(hot)
    hot_side = bounded_broadcast(_scoped_join(side, hot, sc, col, "left_semi"))
    marked = _scoped_join(x, bounded_broadcast(hot.withColumn("_hot", F.lit(True))), sc, col, "left")
    hot_rows = _scoped_join(marked.where("_hot").drop("_hot"), hot_side, sc, col, how)
    cold_rows = _scoped_join(marked.where("_hot IS NULL").drop("_hot"), side, sc, col, how)
    return hot_rows.unionByName(cold_rows)


def _hot(df: DataFrame, cols: Sequence[str], sc: list[str], skew_share: float | None) -> dict[str, DataFrame | None]:
    return heavy_keys(df, cols, skew_share, sc) if skew_share else dict.fromkeys(cols)


def _looked_up_often(ent: DataFrame, skew_share: float | None) -> DataFrame:
    """With ``skew_share`` every column's hot and cold rows look up on their own, so the dictionary is worked out once, before."""
    return _stored(ent) if skew_share else ent


def _relation_side(rel: DataFrame, col: str, sc: list[str], broadcast: bool | str) -> DataFrame:
    # any request to broadcast goes through the size check; False never hints
    if broadcast:
        rel = bounded_broadcast(rel)
    return rel.select(*sc, F.col("relation").alias(col), F.col("id").alias(f"_{col}_id"))


def encode_uri(df: DataFrame, ent: DataFrame, rel: DataFrame, scope: str | Sequence[str] | None = None,
               keep: Sequence[str] = (), broadcast_relations: bool | str = "auto",
               skew_share: float | None = None) -> DataFrame:
    """(s, p, o) URIs -> ids; inner joins, duplicates kept.

    With ``scope`` (e.g. ``"language"``) the lookup is on ``(scope, uri)``
    so each scope uses its own dictionary; ``keep`` columns ride along.
    ``skew_share`` (e.g. 0.01) splits off subjects / objects holding at
    least that share of the rows (see ``_lookup_join``).
    """
    sc = _scope_list(scope)
    x = df.select(*dict.fromkeys([*sc, *keep, "s", "p", "o"]))
    hot, ent = _hot(x, ["s", "o"], sc, skew_share), _looked_up_often(ent, skew_share)
    x = _scoped_join(x, _relation_side(rel, "p", sc, broadcast_relations), sc, "p", "inner")
    x = _lookup_join(x, _entity_side(ent, "s", sc), sc, "s", "inner", hot["s"])
    x = _lookup_join(x, _entity_side(ent, "o", sc), sc, "o", "inner", hot["o"])
    return x.select(*dict.fromkeys([*sc, *keep]), F.col("_s_id").alias("s"), F.col("_p_id").alias("p"),
                    F.col("_o_id").alias("o"))


def encode_literal(df: DataFrame, ent: DataFrame, rel: DataFrame, scope: str | Sequence[str] | None = None,
                   keep: Sequence[str] = (), broadcast_relations: bool | str = "auto",
                   skew_share: float | None = None) -> DataFrame:
    """Subject and predicate -> ids; the literal (o, o_lang, o_datatype) is unchanged."""
    sc = _scope_list(scope)
    x = df.select(*dict.fromkeys([*sc, *keep, "s", "p", "o", "o_lang", "o_datatype"]))
    hot, ent = _hot(x, ["s"], sc, skew_share), _looked_up_often(ent, skew_share)
    x = _scoped_join(x, _relation_side(rel, "p", sc, broadcast_relations), sc, "p", "inner")
    x = _lookup_join(x, _entity_side(ent, "s", sc), sc, "s", "inner", hot["s"])
    return x.select(*dict.fromkeys([*sc, *keep]), F.col("_s_id").alias("s"), F.col("_p_id").alias("p"),
                    "o", "o_lang", "o_datatype")


def _lookup_left(df: DataFrame, ent: DataFrame, rel: DataFrame, sc: list[str], keep: Sequence[str],
                 broadcast_relations: bool | str, skew_share: float | None = None) -> DataFrame:
    x = df.select(*dict.fromkeys([*sc, *keep, "s", "p", "o"]))
    hot, ent = _hot(x, ["s", "o"], sc, skew_share), _looked_up_often(ent, skew_share)
    x = _scoped_join(x, _relation_side(rel, "p", sc, broadcast_relations), sc, "p", "left")
    x = _lookup_join(x, _entity_side(ent, "s", sc), sc, "s", "left", hot["s"])
    return _lookup_join(x, _entity_side(ent, "o", sc), sc, "o", "left", hot["o"])


def encode_strict(df: DataFrame, ent: DataFrame, rel: DataFrame, on_missing: str = "error",
                  scope: str | Sequence[str] | None = None, keep: Sequence[str] = (),
                  broadcast_relations: bool | str = "auto", skew_share: float | None = None) -> DataFrame:
    """Encode by lookup where an unknown URI is an error (or dropped / null).

    Dictionaries must have one id per key (apply ``as_lookup`` first).
    """
    sc = _scope_list(scope)
    if on_missing == "drop":
        return encode_uri(df, ent, rel, scope, keep, broadcast_relations, skew_share)
    if on_missing not in ("error", "null"):
        raise ValueError(f"on_missing must be error, drop or null, not {on_missing!r}")
    x = _lookup_left(df, ent, rel, sc, keep, broadcast_relations, skew_share)
    if on_missing == "error":
        known = F.col("_s_id").isNotNull() & F.col("_p_id").isNotNull() & F.col("_o_id").isNotNull()
        x = x.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat_ws(
            " ", F.lit("unmapped triple:"), F.col("s"), F.col("p"), F.col("o")))))
    return x.select(*dict.fromkeys([*sc, *keep]), F.col("_s_id").alias("s"), F.col("_p_id").alias("p"),
                    F.col("_o_id").alias("o"))


def id_table(dictionaries: Mapping[str, DataFrame], key: str = "entity") -> DataFrame:
    """One stored row per key with its id in each of the named dictionaries, null where it has none.

    One aggregate over the union, instead of an outer join for each dictionary.  A key that a
    dictionary repeats keeps its largest id (D7).
    """
    if not dictionaries:
        raise ValueError("id_table needs at least one dictionary")
    rows = None
    for name in dictionaries:
        part = dictionaries[name].select(F.col(key), *[
            (F.col("id") if other == name else F.lit(None)).cast("long").alias(other) for other in dictionaries])
        rows = part if rows is None else rows.unionByName(part)
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(name).alias(name) for name in dictionaries])
    checkpoint_dir(out.sparkSession)
    return out.checkpoint()


def encode_many(df: DataFrame, entity_ids: DataFrame, relation_ids: DataFrame, keep: Sequence[str] = (),
                broadcast_relations: bool | str = "auto", skew_share: float | None = None) -> DataFrame:
    """J8/A7/A8 under many dictionaries at once: ``keep``, s, p, o and ``<entity ids>_s``, ``<relation ids>_p``, ``<entity ids>_o``.

    ``entity_ids`` and ``relation_ids`` are ``id_table``s.  The rows meet each of
    them once, whatever the number of dictionaries, parts and languages that are encoded; ``encoded`` takes
    one output from the result, which should be persisted.
    """
    keep = list(dict.fromkeys(c for c in keep if c not in ("s", "p", "o")))
    x = df.select(*keep, "s", "p", "o")
    hot = _hot(x, ["s", "o"], [], skew_share)
    relations = bounded_broadcast(relation_ids) if broadcast_relations else relation_ids
    for col, side, split_off in (("p", relations, None), ("s", entity_ids, hot["s"]), ("o", entity_ids, hot["o"])):
        key, *names = side.columns
        ids = side.select(F.col(key).alias(col), *[F.col(n).alias(f"{n}_{col}") for n in names])
        x = _lookup_join(x, ids, [], col, "left", split_off)
    return x


def encoded(many: DataFrame, entity: str, relation: str, on_missing: str = "error", keep: Sequence[str] = ()) -> DataFrame:
    """(s, p, o) ids under one entity and one relation dictionary, from the result of ``encode_many``."""
    if on_missing not in ("error", "drop", "null"):
        raise ValueError(f"on_missing must be error, drop or null, not {on_missing!r}")
    s, p, o = F.col(f"{entity}_s"), F.col(f"{relation}_p"), F.col(f"{entity}_o")
    known = s.isNotNull() & p.isNotNull() & o.isNotNull()
    if on_missing == "drop":
        many = many.where(known)
    elif on_missing == "error":
        many = many.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat_ws(
            " ", F.lit("unmapped triple:"), F.col("s"), F.col("p"), F.col("o")))))
    return many.select(*keep, s.alias("s"), p.alias("p"), o.alias("o"))


def unmapped(df: DataFrame, ent: DataFrame, rel: DataFrame, scope: str | Sequence[str] | None = None,
             broadcast_relations: bool | str = "auto") -> DataFrame:
    """J8 report: triples with an unknown subject, predicate or object, with flags."""
    sc = _scope_list(scope)
    x = _lookup_left(df, ent, rel, sc, (), broadcast_relations)
    return (x.where(F.col("_s_id").isNull() | F.col("_p_id").isNull() | F.col("_o_id").isNull())
            .select(*sc, "s", "p", "o", F.col("_s_id").isNull().alias("s_missing"),
                    F.col("_p_id").isNull().alias("p_missing"), F.col("_o_id").isNull().alias("o_missing")))
