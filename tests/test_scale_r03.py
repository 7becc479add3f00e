"""Work that must not grow faster than the input: links of one hub, rounds of components, lookups of a dictionary, bytes written."""

import glob
import random

from pyspark.sql import functions as F

from kgprep.operators import encode_uri, links
from kgprep.plans.jobs import encode_graph


def test_links_from_one_literal_are_not_a_product(spark):
    ent = spark.range(50).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("entity"), "id").checkpoint()
    hub = spark.range(1, 60).select(F.lit("n0").alias("s"), F.lit("same").alias("p"),
                                    F.concat(F.lit("n"), F.col("id").cast("string")).alias("o"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = links.link_id_pairs(hub, ent)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, i) for i in range(1, 50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_component_rounds_shrink(spark, monkeypatch):
    n, stored, real = 2000, [], links._checkpoint

    def spy(df):
        out = real(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(links, "_checkpoint", spy)
    names = random.Random(5).sample(range(n), n)
    path = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    labels = links.component_labels(path)
    assert {(r.node, r.label) for r in labels.collect()} == {(i, 0) for i in range(n)}
    assert sum(stored) < 12 * n, stored


def test_heavy_split_works_out_the_dictionary_once(spark):
    n, seen = 40, spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    ent = spark.range(n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), "id")
    ent = ent.mapInPandas(count, "entity string, id long")
    rel = spark.createDataFrame([("p", 0)], "relation string, id long")
    t = spark.range(1, n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("s"), F.lit("p").alias("p"),
                                 F.lit("e0").alias("o"))
    got = sorted((r.s, r.p, r.o) for r in encode_uri(t, ent, rel, skew_share=0.5).collect())
    assert got == [(i, 0, 0) for i in range(1, n)]
    assert seen.value == n


def test_encode_graph_writes_compressed(spark, tmp):
    with open(f"{tmp}/a.nt", "w") as f:
        f.write('<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/q> "t"@en .\n_:n <http://x/p> <http://x/b> .\n')
    plain = encode_graph(spark, f"{tmp}/a.nt", f"{tmp}/plain", readable=True)
    small = encode_graph(spark, f"{tmp}/a.nt", f"{tmp}/small", readable=True, compression="gzip")
    assert plain.keys() == small.keys() and len(plain) == 7
    for name in plain:
        assert not glob.glob(f"{small[name]}/*.txt") and glob.glob(f"{small[name]}/*.txt.gz")
        read = [sorted(r.value for r in spark.read.text(outs[name]).collect()) for outs in (plain, small)]
        assert read[0] == read[1]
