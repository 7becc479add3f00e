"""Seeded, exact splits per language.

The permutation is ``md5(seed, row)`` order within each language: the same
input gives the same parts on any cluster, partitioning or retry.

``split`` needs no ranks, only the rows at which parts begin.  These are found by
selection: a histogram of hash prefixes per language shows the bucket that
holds the k-th row, and only that bucket is looked at more closely, until it is small enough
to be sorted.  Rows then get their part by comparison with
those few rows, where they are: no row is shuffled.  Rows equal to such a row are
counted, and as many as belong to each part are made anew.

``shuffle_rank`` gives every row its rank.  Ranks
come from the bucketed running sum of ``ids.dense_ids`` generalised to
counted rows: identical rows are first collapsed to ``(row, copies)`` with
map-side partial aggregation, so a row repeated a billion times travels
as one row per map task, and its copies are re-created after ranking.
Copies of a hot row are re-created in chunks spread over many tasks, never
in one task.  Part sizes are exact: ``floor(0.7D * n)`` in double
arithmetic, as the reference computes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgprep.operators.encode import bounded_broadcast
from kgprep.operators.ids import _scope_list, bucket_digits_for, bucket_offsets, join_null_safe
from kgprep.session import checkpoint_dir

TRAIN_TEST = (("train", 0.8), ("test", 1.0))
TRAIN_VALID_TEST = (("train", 0.7), ("valid", 0.85), ("test", 1.0))
COPY_CHUNK = 1 << 16
STEP_DIGITS = 3  # hex digits that each look at a bucket adds: 4,096 counts
SORT_ROWS = 1 << 16  # a bucket of so many rows is sorted; a larger one is looked at again


def language_counts(df: DataFrame, by: str = "language") -> DataFrame:
    """Rows per language."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def row_hash(cols: Sequence[str], seed: str) -> Column:
    """md5 over the seed and the row's fields joined by tabs."""
    return F.md5(F.concat_ws("\t", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _expand(ranked: DataFrame, cols: list[str], chunk: int) -> DataFrame:
    """One output row per copy: ``rank = start + i`` for i in [0, copies).

    Every row gives its chunks of copies, one for an ordinary row.  The
    rebalance then spreads the chunks over the tasks before the copies are made,
    so a row with a billion copies is the work of many tasks.
    """
    chunks = F.sequence(F.lit(0), F.ceil(F.col("_c") / chunk).cast("long") - 1)
    rows = ranked.select(*cols, "_n", "_start", "_c", F.explode(chunks).alias("_k")).hint("rebalance")
    first = F.col("_start") + F.col("_k") * chunk
    last = F.least(F.col("_start") + F.col("_c"), first + chunk) - 1
    return rows.select(*cols, "_n", F.explode(F.sequence(first, last)).alias("rank"))


def _ranked(df: DataFrame, by: str | Sequence[str] | None, seed: str, hash_cols: Sequence[str] | None,
            bucket_digits: int | None, chunk: int) -> DataFrame:
    sc = _scope_list(by)
    cols = list(df.columns)
    data_cols = [c for c in cols if c not in sc]
    hcols = list(hash_cols) if hash_cols else data_cols
    digits = bucket_digits or bucket_digits_for(df)
    # rows without a group value are a group of their own
    counted = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_h", row_hash(hcols, seed))
               .withColumn("_b", F.substring("_h", 1, digits)))
    # sums combine map-side; the exchange of the collapsed rows feeds both branches
    buckets = counted.groupBy(*sc, "_b").agg(F.sum("_c").alias("_bn"))
    offsets = bucket_offsets(buckets, sc, "_bn", total="_n")
    inside = (Window.partitionBy(*sc, "_b").orderBy("_h", *data_cols)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (join_null_safe(counted.withColumn("_cum", F.sum("_c").over(inside)), offsets, [*sc, "_b"])
              .withColumn("_start", (F.col("_off") + F.col("_cum") - F.col("_c")).cast("long")))
    return _expand(ranked, cols, chunk)


def shuffle_rank(df: DataFrame, by: str | Sequence[str] | None = "language", seed: str = "0",
                 rank_col: str = "rank", hash_cols: Sequence[str] | None = None,
                 bucket_digits: int | None = None, chunk: int = COPY_CHUNK) -> DataFrame:
    """A seeded random permutation within each group: ``rank`` 0..n-1."""
    out = _ranked(df, by, seed, hash_cols, bucket_digits, chunk)
    return out.select(*df.columns, F.col("rank").alias(rank_col))


def cumulative_bounds(fractions: Mapping[str, float]) -> tuple[tuple[str, float], ...]:
    """``{"train": 0.7, "valid": 0.15, "test": 0.15}`` -> cumulative bounds
    ``(("train", 0.7), ("valid", 0.85), ("test", 1.0))``; sums are rounded
    to 12 decimals so that 0.1 + 0.2 gives the bound 0.3."""
    out, acc = [], 0.0
    for name, frac in fractions.items():
        acc = round(acc + float(frac), 12)
        out.append((name, acc))
    if out and abs(out[-1][1] - 1.0) > 1e-9:
        raise ValueError(f"fractions must sum to 1, not {out[-1][1]}")
    return tuple(out)


def _stored(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_rows(df: DataFrame, by: str | Sequence[str] | None, bounds: Sequence[float], seed: str = "0",
             hash_cols: Sequence[str] | None = None, step_digits: int = STEP_DIGITS,
             sort_rows: int = SORT_ROWS) -> DataFrame:
    """For each group and bound b the row of rank floor(b * n) in hash order: stored ``(group, _cut, _k, _n, _row, _start, _c)``.

    ``_row`` is a struct of the hash and the other columns, ``_start`` the rank of the first of its ``_c``
    copies.  A bound whose rank is n has no row and is left out.  ``df`` is read once for each look
    at the buckets, each time for one aggregate that combines map-side.
    """
    sc = _scope_list(by)
    data_cols = [c for c in df.columns if c not in sc]
    row = F.struct(row_hash(list(hash_cols) if hash_cols else data_cols, seed).alias("_h"), *data_cols)
    rows = df.select(*sc, row.alias("_row"))
    sizes = rows.groupBy(*sc).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sizes.select(*sc, "_n", F.posexplode(F.array(*[F.floor(F.lit(float(b)) * F.col("_n").cast("double")) for b in bounds]))
                        .alias("_cut", "_k")).where("_k < _n")
    # the cut's bucket: its prefix, the rank of its first row and its number of rows
    cuts = _stored(cuts.withColumns({"_b": F.lit(""), "_off": F.lit(0).cast("long"), "_c": F.col("_n")}))
    digits, most = 0, cuts.agg(F.max("_c")).first()[0] or 0
    while most > sort_rows and digits < 32:
        digits += step_digits
        old = bounded_broadcast(_stored(cuts.select(*sc, "_b").distinct()))
        prefix, longer = (F.substring("_row._h", 1, n) for n in (digits - step_digits, digits))
        near = join_null_safe(rows.select(*sc, prefix.alias("_b"), longer.alias("_to")), old, [*sc, "_b"], "left_semi")
        counts = near.groupBy(*sc, "_b", "_to").agg(F.count(F.lit(1)).alias("_m"))
        before = Window.partitionBy(*sc, "_b").orderBy("_to").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        cuts = join_null_safe(cuts.drop("_c"), counts, [*sc, "_b"], "inner")
        first = F.col("_off") + F.col("_before")
        cuts = cuts.where((first <= F.col("_k")) & (F.col("_k") < first + F.col("_m"))).select(
            *sc, "_n", "_cut", "_k", F.col("_to").alias("_b"), first.alias("_off"), F.col("_m").alias("_c"))
        cuts = _stored(cuts)
        larger, most = most, cuts.agg(F.max("_c")).first()[0] or 0
        if most == larger and digits >= 4 * step_digits:
            break  # copies of one row: they are counted below, whatever their number
    old = bounded_broadcast(_stored(cuts.select(*sc, "_b").distinct()))
    near = join_null_safe(rows.withColumn("_b", F.substring("_row._h", 1, digits)), old, [*sc, "_b"], "left_semi")
    near = near.groupBy(*sc, "_b", "_row").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*sc, "_b").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.sum("_c").over(upto))
    found = join_null_safe(cuts.drop("_c"), near, [*sc, "_b"], "inner")
    start = F.col("_off") + F.col("_upto") - F.col("_c")
    return _stored(found.where((start <= F.col("_k")) & (F.col("_k") < start + F.col("_c"))).select(
        *sc, "_cut", "_k", "_n", "_row", start.alias("_start"), "_c"))


def split(df: DataFrame, by: str | Sequence[str] | None = "language",
          parts: Sequence[tuple[str, float]] | Mapping[str, float] = TRAIN_VALID_TEST, seed: str = "0",
          part_col: str = "part", hash_cols: Sequence[str] | None = None, chunk: int = COPY_CHUNK,
          step_digits: int = STEP_DIGITS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Exact split per group.  ``parts`` are cumulative upper bounds:
    part i takes ranks in ``[floor(b_{i-1} * n), floor(b_i * n))``, the last
    part takes the rest.  A mapping of per-part fractions is accepted too
    (``cumulative_bounds``).  Rows without a group value are a group of their own.

    ``df`` is read several times (``cut_rows``), so it must give the same rows each time.
    """
    if isinstance(parts, Mapping):
        parts = cumulative_bounds(parts)
    sc = _scope_list(by)
    cols = list(df.columns)
    data_cols = [c for c in cols if c not in sc]
    names = [name for name, _ in parts]
    if len(names) == 1:
        return df.select(*cols, F.lit(names[0]).alias(part_col))
    cuts = cut_rows(df, by, [b for _, b in parts[:-1]], seed, hash_cols, step_digits, sort_rows)
    of_group = cuts.groupBy(*sc).agg(F.collect_list(F.struct("_row", "_cut")).alias("_cuts"))
    row = F.struct(row_hash(list(hash_cols) if hash_cols else data_cols, seed).alias("_h"), *data_cols)
    side = bounded_broadcast(_stored(of_group))
    rows = join_null_safe(df.withColumn("_row", row), side, sc) if sc else df.withColumn("_row", row).join(
        F.broadcast(of_group), how="left")  # one row: there are no groups
    passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: F.col("_row") > c["_row"]))
    at_cut = F.exists(F.coalesce("_cuts", F.array()), lambda c: F.col("_row") == c["_row"])
    label = F.element_at(F.array(*map(F.lit, names)), passed + 1).alias(part_col)
    away = rows.where(~at_cut).select(*cols, label)
    # copies of the rows at the cuts: ranks _start.._start + _c - 1 are dealt to the parts they fall in
    n = F.col("_n").cast("double")
    ends = [F.lit(0).cast("long"), *[F.floor(F.lit(float(b)) * n) for _, b in parts[:-1]], F.col("_n")]
    first, last = F.col("_start"), F.col("_start") + F.col("_c")
    shares = F.explode(F.array(*[
        F.struct(F.lit(name).alias(part_col), (F.least(hi, last) - F.greatest(lo, first)).cast("long").alias("_m"))
        for name, lo, hi in zip(names, ends, ends[1:])]))
    same = cuts.select(*sc, "_row", "_start", "_c", "_n").distinct().select(*sc, "_row", shares.alias("_x")).where("_x._m > 0")
    same = same.select(*sc, *[F.col("_row")[c].alias(c) for c in data_cols], F.col(f"_x.{part_col}").alias(part_col),
                       F.lit(0).cast("long").alias("_start"), F.col("_x._m").alias("_c"), F.lit(0).alias("_n"))
    made = _expand(same, [*cols, part_col], chunk)
    return away.unionByName(made.select(*cols, part_col))


def joint(df: DataFrame, part: str, by: str = "language", part_col: str = "part") -> DataFrame:
    """One part over all languages, language column dropped."""
    return df.where(F.col(part_col) == part).drop(by, part_col)


def language_part(df: DataFrame, language: str, part: str, by: str = "language",
                  part_col: str = "part") -> DataFrame:
    """One language's part, URIs kept."""
    return df.where((F.col(by) == language) & (F.col(part_col) == part)).drop(by, part_col)
