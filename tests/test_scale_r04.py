"""CPU and bytes that grow with the input: bzip2 files written and read, lines parsed, scans for a dictionary."""

import bz2
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helpers import lines_df
from kgprep.functions.nodes import WELL_ESCAPED, unescape
from kgprep.operators import ids
from kgprep.plans.jobs import encode_graph
from kgprep.sinks import text as K
from kgprep.sources import parse_ntriples, read_ntriples


def test_bzip2_parts_hold_every_line_in_order(spark, tmp):
    lines = [f"line {i} é\t\\" for i in range(3000)] + ["", None, " x "]
    K.write_bzip2(lines_df(spark, lines).coalesce(1), f"{tmp}/one")
    (part,) = glob.glob(f"{tmp}/one/*")
    data = open(part, "rb").read()
    assert part.endswith("part-00000.txt.bz2") and data[:4] == b"BZh1"
    assert bz2.decompress(data).decode() == "".join(f"{x or ''}\n" for x in lines)
    K.write_bzip2(lines_df(spark, lines).repartition(3), f"{tmp}/many")
    assert len(glob.glob(f"{tmp}/many/*.bz2")) == len(glob.glob(f"{tmp}/many/*")) == 3
    assert sorted(r.value for r in spark.read.text(f"{tmp}/many").collect()) == sorted(x or "" for x in lines)
    with pytest.raises(FileExistsError):
        K.write_bzip2(lines_df(spark, lines), f"{tmp}/one")


def test_bzip2_of_no_lines_can_be_read(spark, tmp):
    K.write_bzip2(lines_df(spark, ["x"]).where("value = 'y'"), f"{tmp}/none")
    assert read_ntriples(spark, f"{tmp}/none/*.bz2").collect() == []


def test_bzip2_part_is_read_by_many_tasks(spark, tmp):
    n = 60_000
    rows = spark.range(n, numPartitions=1).select(F.concat(
        F.lit("<http://x/"), F.md5(F.col("id").cast("string")), F.lit("> <http://x/p> <http://x/o> .")).alias("value"))
    K.write_bzip2(rows, f"{tmp}/big")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        g = read_ntriples(spark, f"{tmp}/big/*.bz2")
        assert g.rdd.getNumPartitions() > 8
        assert g.count() == n and g.select("s").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("mode", ["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
def test_lines_are_picked_in_generated_code(spark, tmp, mode):
    with open(f"{tmp}/a.nt", "w") as f:
        f.write("# c\n")
    plan = read_ntriples(spark, f"{tmp}/a.nt", mode=mode)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Generate explode" in x and "*(" in x]
    assert plan.count("regexp_replace(value") == 1  # the statement regex runs once a line


def test_escape_test_agrees_with_the_decoder(spark):
    r = random.Random(11)
    cells = ["\\", "u", "U", "d83d", "DE00", "0010", "0000", "00e9", "FFFF", "t", "n", '"', "'", "é", "x", "\U0001F600", "\r"]
    texts = ["".join(r.choice(cells) for _ in range(r.randint(0, 7))) for _ in range(6000)]
    texts += ["\\" + "".join(r.choice(cells[1:]) for _ in range(4)) for _ in range(6000)] + ["\\\\" * 50_000]
    got = lines_df(spark, texts).select("value", F.col("value").rlike(WELL_ESCAPED).alias("a"),
                                        unescape("value").isNotNull().alias("b")).collect()
    assert 1000 < sum(x.a for x in got) < len(got) - 1000
    assert [x.value for x in got if x.a != x.b] == []


def test_parts_of_odd_statements(spark):
    lines = ['<> <> <> .', '<s> <p> "" .', '<s> <p> ""@en .', '<s> <p> ""^^<> .', '_:a. <p> _:b. .', '_:a\t<p\\u0041>\t<o b>.# \\x',
             '<s\\u00e9> <p> "a\\"b\\\\"^^<t> .']
    got = [tuple(x) for x in parse_ntriples(lines_df(spark, lines).coalesce(1)).collect()]
    assert got == [
        ("", "uri", "", "", "uri", None, None), ("s", "uri", "p", "", "literal", None, None),
        ("s", "uri", "p", "", "literal", "en", None), ("s", "uri", "p", "", "literal", None, None),
        ("_:a.", "blank", "p", "_:b.", "blank", None, None), ("_:a", "blank", "pA", "o b", "uri", None, None),
        ("sé", "uri", "p", 'a"b\\', "literal", None, "t")]
    bad = ['<s\\> <p> <o> .', '<s> <p> "\\ud83d" .', '<s> <p> "a"^^<t\\> .', '<s> <p> "x', "<a> <b> <c>"]
    rows = parse_ntriples(lines_df(spark, [*bad, "# c", ""]), mode="PERMISSIVE").collect()
    assert sorted(x._corrupt_record for x in rows) == sorted(bad) and not any(x.s or x.o_kind or x.o_lang for x in rows)


def test_encode_graph_scans_the_triples_once_for_a_dictionary(spark, tmp, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), ids.entities

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    monkeypatch.setattr(ids, "entities", lambda df, scope=None: real(df, scope).mapInPandas(count, "entity string"))
    with open(f"{tmp}/a.nt", "w") as f:
        f.write("".join(f"<http://x/{i}> <http://x/p{i % 3}> <http://x/{i + 1}> .\n" for i in range(30)))
    outs = encode_graph(spark, f"{tmp}/a.nt", f"{tmp}/out")
    found = [r.value[1:-1].split(",") for r in spark.read.text(outs["entity_ids"]).collect()]
    assert len(found) == seen.value == 31 and sorted(int(i) for _, i in found) == list(range(31))
    assert spark.read.text(outs["uri_mappings"]).count() == 30


def test_ids_without_scope_keep_the_keys_in_their_buckets(spark):
    keys = lines_df(spark, [f"k{i}" for i in range(50)] + [None]).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = ids.dense_ids(keys, "value")
        got = {r.value: r.id for r in d.collect()}
        assert "coalesce(_b#" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ranked = sorted((f"k{i}" for i in range(50)), key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    assert got == {k: i for i, k in enumerate(ranked)}
