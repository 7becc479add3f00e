"""Dense ids (D3-D9) and exact splits."""

import collections
import math

from pyspark.sql import functions as F

from kgprep.operators import (append_relation, as_lookup, dense_ids, joint, language_counts, language_part,
                              shuffle_rank, sorted_by_id, split)
from kgprep.operators.splits import TRAIN_VALID_TEST


def _keys(spark, n, scope=None):
    rows = [(f"k{i}", scope[i % len(scope)] if scope else None) for i in range(n)]
    return spark.createDataFrame(rows, "key string, lang string")


def test_dense_ids_bijection_and_partition_invariance(spark):
    keys = _keys(spark, 5000).select("key")
    a = {r.key: r.id for r in dense_ids(keys, "key", bucket_digits=2).collect()}
    b = {r.key: r.id for r in dense_ids(keys.repartition(13), "key", bucket_digits=3).collect()}
    assert sorted(a.values()) == list(range(5000))
    assert a == b  # a pure function of the data


def test_dense_ids_per_scope(spark):
    keys = _keys(spark, 1000, ["de", "en", "es"])
    ids = dense_ids(keys, "key", scope="lang").collect()
    per = collections.defaultdict(list)
    for r in ids:
        per[r.lang].append(r.id)
    assert {k: sorted(v) for k, v in per.items()} == {k: list(range(len(v))) for k, v in per.items()}


def test_dense_ids_plan_has_single_partition_only_on_bucket_table(spark):
    keys = _keys(spark, 100).select("key")
    plan = dense_ids(keys, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1


def test_lookup_sorted_append(spark):
    d = spark.createDataFrame([("a", 0), ("b", 1), ("a", 5)], "entity string, id long")
    assert {r.entity: r.id for r in as_lookup(d).collect()} == {"a": 5, "b": 1}
    rel = spark.createDataFrame([("p0", 0), ("p1", 1)], "relation string, id long")
    out = {r.relation: r.id for r in append_relation(rel, "sameAs").collect()}
    assert out["sameAs"] == 2
    bad = spark.createDataFrame([("p0", 0), ("p1", 7)], "relation string, id long")
    try:
        append_relation(bad, "sameAs").collect()
        raise AssertionError("expected a density error")
    except Exception as e:  # noqa: BLE001
        assert "dense" in str(e)
    ids = [r.id for r in sorted_by_id(spark.range(100).withColumnRenamed("id", "id"), 4).collect()]
    assert ids == sorted(ids)


def _quads(spark, sizes):
    rows = []
    for lang, n in sizes.items():
        rows += [(f"s{lang}{i}", "p", f"o{i}", lang) for i in range(n)]
    return spark.createDataFrame(rows, "s string, p string, o string, language string")


def test_split_sizes_exact(spark):
    sizes = {"a": 0, "b": 1, "c": 2, "d": 10, "e": 90}
    sizes = {k: v for k, v in sizes.items() if v}
    out = split(_quads(spark, sizes), "language", TRAIN_VALID_TEST, seed="7")
    got = collections.Counter((r.language, r.part) for r in out.collect())
    for lang, n in sizes.items():
        tr, va = math.floor(0.7 * n), math.floor(0.85 * n)
        assert got[(lang, "train")] == tr
        assert got[(lang, "valid")] == va - tr
        assert got[(lang, "test")] == n - va
    assert got[("e", "train")] == 62 and got[("e", "valid")] == 14 and got[("e", "test")] == 14


def test_split_reproducible_and_disjoint(spark):
    q = _quads(spark, {"x": 500, "y": 37})
    a = sorted(tuple(r) for r in split(q, seed="s").collect())
    b = sorted(tuple(r) for r in split(q.repartition(7), seed="s").collect())
    assert a == b
    keys = [(r[0], r[3]) for r in a]
    assert len(keys) == len(set(keys)) == 537


def test_hot_copies_are_ranked_exactly(spark):
    # one row repeated 1000 times plus 200 distinct rows; tiny chunk forces the spread path
    rows = [("hot", "p", "o", "en")] * 1000 + [(f"s{i}", "p", "o", "en") for i in range(200)]
    q = spark.createDataFrame(rows, "s string, p string, o string, language string")
    ranks = [r["rank"] for r in shuffle_rank(q, seed="1", chunk=64).collect()]
    assert sorted(ranks) == list(range(1200))
    out = split(q, seed="1", chunk=64).collect()
    c = collections.Counter(r.part for r in out)
    assert c == {"train": 840, "valid": 180, "test": 180}


def test_counts_joint_language_part(spark):
    q = _quads(spark, {"es": 20, "ja": 10})
    assert {r.language: r.n for r in language_counts(q).collect()} == {"es": 20, "ja": 10}
    parts = split(q, seed="0")
    assert joint(parts, "train").columns == ["s", "p", "o"]
    assert joint(parts, "train").count() == 14 + 7
    assert language_part(parts, "es", "test").count() == 3
    assert parts.where(F.col("part").isNull()).count() == 0


def test_split_accepts_fractions(spark):
    from kgprep.operators.splits import cumulative_bounds
    assert cumulative_bounds({"a": 0.1, "b": 0.2, "c": 0.7}) == (("a", 0.1), ("b", 0.3), ("c", 1.0))
    q = _quads(spark, {"x": 90})
    got = collections.Counter(r.part for r in split(q, parts={"train": 0.7, "valid": 0.15, "test": 0.15}).collect())
    assert got == {"train": 62, "valid": 14, "test": 14}


def test_null_group_and_null_scope_are_kept(spark):
    from kgprep.operators import dense_ids, shuffle_rank, split
    df = spark.createDataFrame([("a", "en"), ("b", "en"), ("a", None), ("c", None), ("c", None)],
                               "s string, language string")
    assert split(df, seed="1").count() == 5
    ranks = {}
    for r in shuffle_rank(df, seed="1").collect():
        ranks.setdefault(r.language, []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {"en": [0, 1], None: [0, 1, 2]}
    ids = dense_ids(df.distinct(), "s", "language").collect()
    assert sorted((r.language or "", r.id) for r in ids) == [("", 0), ("", 1), ("en", 0), ("en", 1)]


def test_bucket_digits_follow_the_partitions_and_do_not_change_ids(spark):
    from kgprep.operators import dense_ids
    from kgprep.operators.ids import bucket_digits_for
    keys = spark.range(500).selectExpr("concat('k', id) AS k")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    base = {r.k: r.id for r in dense_ids(keys, "k").collect()}
    assert {r.k: r.id for r in dense_ids(keys, "k", bucket_digits=6).collect()} == base
    spark.conf.set("spark.sql.shuffle.partitions", "800000")
    assert bucket_digits_for(keys) == 6
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_appending_a_known_relation_changes_nothing(spark):
    from kgprep.operators import append_relation
    rel = spark.createDataFrame([("p", 0), ("sameAs", 1)], "relation string, id long")
    assert sorted(tuple(r) for r in append_relation(rel, "sameAs").collect()) == [("p", 0), ("sameAs", 1)]
    assert append_relation(rel.limit(0), "sameAs").collect()[0].id == 0
