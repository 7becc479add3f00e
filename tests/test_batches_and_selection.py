"""Splits by selection, two-level offsets, growing dictionaries and components, one encode for many dictionaries."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from kgprep.operators.encode import encode_many, encode_strict, encoded, id_table
from kgprep.operators.ids import dense_ids, grow_dictionary
from kgprep.operators.links import component_labels, grow_components
from kgprep.operators.splits import TRAIN_VALID_TEST, shuffle_rank, split

NAMES = ("train", "valid", "test")


def plain_split(rows, seed, bounds=(0.7, 0.85)):
    """(s, p, o, language, part) by sorting everything; rows are (s, p, o, language)."""
    out = []
    for lang in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == lang]
        # concat_ws leaves nulls out; nulls come first among equal hashes
        mine.sort(key=lambda r: (hashlib.md5("\t".join([seed, *[x for x in r[:3] if x is not None]]).encode()).hexdigest(),
                                 [(x is not None, x or "") for x in r[:3]]))
        cuts = [math.floor(b * float(len(mine))) for b in bounds]
        out += [(*r, NAMES[sum(i >= c for c in cuts)]) for i, r in enumerate(mine)]
    return Counter(out)


def some_rows(seed=1, n=900):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(400)}", "p", f"o{rng.randrange(3)}", rng.choice(["a", "a", "b", None])) for _ in range(n)]
    rows += [("hot", "p", "o", "a")] * 700 + [("hot", "p", "o", "b")] * 3 + [("one", "p", "o", "c")] + [("two", None, "o", "d")] * 2
    return rows + [("x", None, "y", "e"), ("x", "y", None, "e"), (None, "x", "y", "e")] * 4


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("step, few", [(3, 1 << 16), (1, 5), (2, 40)])
def test_selection_gives_the_split_of_a_full_sort(spark, step, few):
    rows = some_rows()
    df = spark.createDataFrame(rows, "s string, p string, o string, language string").repartition(5)
    for seed in ("0", "7"):
        got = split(df, seed=seed, step_digits=step, sort_rows=few, chunk=64)
        assert got.columns == ["s", "p", "o", "language", "part"]
        assert Counter(map(tuple, got.collect())) == plain_split(rows, seed)


def test_selection_without_groups_and_with_awkward_sizes(spark):
    for n in (0, 1, 2, 10, 90):
        df = spark.range(n).selectExpr("cast(id AS string) AS s")
        parts = Counter(r.part for r in split(df, None, seed="3", sort_rows=4, step_digits=1).collect())
        cuts = [math.floor(0.7 * n), math.floor(0.85 * n), n]
        assert [parts[x] for x in NAMES] == [cuts[0], cuts[1] - cuts[0], n - cuts[1]]
    same = spark.createDataFrame([("r",)] * 1000, "s string")  # one row, repeated
    parts = Counter(r.part for r in split(same, None, sort_rows=10, chunk=7).collect())
    assert parts == {"train": 700, "valid": 150, "test": 150}
    assert split(same, None, (("all", 1.0),)).where("part = 'all'").count() == 1000
    uneven = split(same, None, {"a": 0.001, "b": 0.0, "c": 0.999})
    assert Counter(r.part for r in uneven.collect()) == {"a": 1, "c": 999}


def test_split_shuffles_no_rows(spark, tmp):
    spark.range(20000).selectExpr("concat('s', id) AS s", "'p' AS p", "cast(id % 7 AS string) AS o",
                                  "IF(id % 3 = 0, 'a', 'b') AS language").write.parquet(f"{tmp}/q")
    df = split(spark.read.parquet(f"{tmp}/q"), seed="1", sort_rows=100)
    plan = final_plan(df)
    scan = [b for b in re.split(r"(?=:- |\+- Union|Union)", plan) if "q]" in b or "/q" in b]
    assert scan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    branch = plan[plan.index("Union"):]
    branch = branch[:branch.index(":- ", branch.index("FileScan"))] if ":- " in branch[branch.index("FileScan"):] else branch
    rows_side = branch[:branch.index("FileScan")]
    assert "hashpartitioning(language" not in rows_side.split("BroadcastQueryStage")[0]
    assert Counter(r.part for r in df.collect()) == {
        p: n for p, n in zip(NAMES, (math.floor(0.7 * 6667) + math.floor(0.7 * 13333),
                                     math.floor(0.85 * 6667) + math.floor(0.85 * 13333) - math.floor(0.7 * 6667) - math.floor(0.7 * 13333),
                                     20000 - math.floor(0.85 * 6667) - math.floor(0.85 * 13333)))}


def test_no_task_holds_the_bucket_table(spark):
    """Without a scope, only the sums by the first two digits meet in one task."""
    keys = spark.range(50000).selectExpr("concat('k', id) AS key")
    for df in (dense_ids(keys, "key"), shuffle_rank(keys, None)):
        plan = re.sub(r"#\d+L?", "", final_plan(df))
        assert "hashpartitioning(_t," in plan
        # what goes to the single partition is grouped by _t before
        for at in [m.start() for m in re.finditer("SinglePartition", plan)]:
            below = plan[at:at + 600]
            assert "HashAggregate(keys=[_t]" in below, below


def test_dictionary_grows_and_keeps_ids(spark):
    first = [f"k{i}" for i in range(300)]
    second = [f"k{i}" for i in range(200, 700)] * 2 + [None]
    schema = "entity string"
    one = dense_ids(spark.createDataFrame([(x,) for x in first], schema), "entity")
    two = grow_dictionary(one, spark.createDataFrame([(x,) for x in second], schema))
    old, new = dict(map(tuple, one.collect())), dict(map(tuple, two.collect()))
    assert all(new[k] == i for k, i in old.items()) and sorted(new.values()) == list(range(700))
    fresh = sorted(set(second) - set(first) - {None}, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    assert [new[k] for k in fresh] == list(range(300, 700))
    assert sorted(map(tuple, grow_dictionary(two, spark.createDataFrame([], schema)).collect())) == sorted(new.items())
    empty = grow_dictionary(one.limit(0), spark.createDataFrame([("a",)], schema))
    assert [tuple(r) for r in empty.collect()] == [("a", 0)]
    with pytest.raises(Exception, match="dense"):
        grow_dictionary(one.where("id <> 0"), spark.createDataFrame([("a",)], schema)).collect()


def test_dictionary_grows_by_scope(spark):
    schema = "language string, entity string"
    one = dense_ids(spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], schema), "entity", "language")
    two = grow_dictionary(one, spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "x"), (None, "x"), (None, "w")], schema),
                          scope="language")
    got = {(r.language, r.entity): r.id for r in two.collect()}
    assert {k: got[k] for k in [("a", "z"), ("b", "x"), (None, "w")]} == {("a", "z"): 2, ("b", "x"): 0, (None, "w"): 1}
    assert len(got) == 6 and {(r.language, r.entity): r.id for r in one.collect()}.items() <= got.items()


def test_components_grow_to_those_of_all_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (900, 900)]
    frames = [spark.createDataFrame(part, "a long, b long") for part in (links[:100], links[100:180], links[180:])]
    labels = component_labels(frames[0])
    for more in frames[1:]:
        labels = grow_components(labels, more)
    whole = component_labels(spark.createDataFrame(links, "a long, b long"))
    got, expected = dict(map(tuple, labels.collect())), dict(map(tuple, whole.collect()))
    # a node that only has a loop is a component of its own
    assert {n: l for n, l in got.items() if n in expected} == expected
    assert all(n == l for n, l in got.items() if n not in expected)
    assert labels.count() == len(got)


def test_one_encode_for_many_dictionaries(spark):
    rows = [(f"e{i % 50}", f"r{i % 3}", f"e{(i * 7) % 50}", "es" if i < 40 else "en") for i in range(400)]
    q = spark.createDataFrame(rows, "s string, p string, o string, language string")
    d = [spark.createDataFrame([(f"e{i}", k * 1000 + i) for i in range(50 if k < 2 else 48)], "entity string, id long") for k in range(3)]
    rel = spark.createDataFrame([(f"r{i}", i) for i in range(3)], "relation string, id long")
    table, relations = id_table({"given": d[0], "merged": d[1], "own": d[2]}), id_table({"given": rel}, "relation")
    many = encode_many(q, table, relations, keep=["language"])
    for name, one in (("given", d[0]), ("merged", d[1])):
        assert Counter(map(tuple, encoded(many, name, "given").collect())) == Counter(map(tuple, encode_strict(q, one, rel).collect()))
    with pytest.raises(Exception, match="unmapped triple"):
        encoded(many, "own", "given").collect()
    for how in ("drop", "null"):
        assert Counter(map(tuple, encoded(many, "own", "given", how).collect())) == Counter(
            map(tuple, encode_strict(q, d[2], rel, how).collect()))
    # three dictionaries, two entity joins
    plan = encode_many(q, table, relations)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 3
    skewed = encode_many(q, table, relations, keep=["language"], skew_share=0.1)
    assert Counter(map(tuple, skewed.collect())) == Counter(map(tuple, many.collect()))
    repeated = id_table({"given": d[0].unionByName(d[0].selectExpr("entity", "id + 7 AS id"))})
    assert repeated.where("entity = 'e3'").first()["given"] == 10


def test_parts_of_a_split_agree_with_ranks(spark):
    q = spark.range(3000).selectExpr("concat('s', id) AS s", "'p' AS p", "'o' AS o", "IF(id % 3 = 0, 'a', 'b') AS language")
    ranks = {r.s: r.rank for r in shuffle_rank(q, "language", "5").collect()}
    for r in split(q, "language", TRAIN_VALID_TEST, "5", sort_rows=50).collect():
        n = 1000 if r.language == "a" else 2000
        assert r.part == NAMES[sum(ranks[r.s] >= math.floor(b * n) for b in (0.7, 0.85))]
