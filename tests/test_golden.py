"""Golden sample: ids are arbitrary, so compare decoded triples and id ranges."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from helpers import REFERENCE
from kgprep.operators import encode_literal, encode_uri, entity_dictionary, literal_triples, relation_dictionary, uri_triples
from kgprep.plans.jobs import encode_graph
from kgprep.sinks.text import readable_text
from kgprep.sources import read_ntriples

SAMPLE = os.path.join(REFERENCE, "small_person.ttl")
pytestmark = pytest.mark.skipif(not os.path.exists(SAMPLE), reason="golden sample not present")


@pytest.fixture(scope="module")
def graph(spark):
    return read_ntriples(spark, SAMPLE).cache()


def _sample_lines(name):
    with open(os.path.join(REFERENCE, name, "part-00000"), encoding="utf-8") as f:
        return [x.rstrip("\n") for x in f if x.strip()]


def test_counts(graph):
    assert graph.count() == 1000
    assert literal_triples(graph).count() == 622
    assert uri_triples(graph).count() == 378
    kinds = {(r.o_lang, r.o_datatype): r["count"] for r in graph.where("o_kind = 'literal'")
             .groupBy("o_lang", "o_datatype").count().collect()}
    assert kinds[("en", None)] == 425
    assert kinds[(None, "http://www.w3.org/2001/XMLSchema#date")] == 159
    assert kinds[(None, "http://www.w3.org/2001/XMLSchema#gYear")] == 38


def test_dictionaries_dense_and_equal_to_sample(graph):
    ent = entity_dictionary(graph).collect()
    rel = relation_dictionary(graph).collect()
    assert sorted(r.id for r in ent) == list(range(305))
    assert sorted(r.id for r in rel) == list(range(9))
    # sample layout "(uri,id)"; URIs hold commas, so split on the last one
    sample_ent = {line[1:-1].rsplit(",", 1)[0] for line in _sample_lines("EntityId")}
    sample_rel = {line[1:-1].rsplit(",", 1)[0] for line in _sample_lines("RelationId")}
    assert {r.entity for r in ent} == sample_ent
    assert {r.relation for r in rel} == sample_rel


def test_encode_decode_is_identity(graph):
    ent, rel = entity_dictionary(graph), relation_dictionary(graph)
    enc = encode_uri(uri_triples(graph), ent, rel)
    e = {r.id: r.entity for r in ent.collect()}
    p = {r.id: r.relation for r in rel.collect()}
    decoded = collections.Counter((e[r.s], p[r.p], e[r.o]) for r in enc.collect())
    original = collections.Counter((r.s, r.p, r.o) for r in uri_triples(graph).collect())
    assert decoded == original and sum(decoded.values()) == 378


def test_sample_mapping_decodes_to_same_bag(graph):
    # The sample's own ids decode (with the sample dictionaries) to the same bag we encode.
    def dct(name):
        return {int(line[1:-1].rsplit(",", 1)[1]): line[1:-1].rsplit(",", 1)[0] for line in _sample_lines(name)}
    e, p = dct("EntityId"), dct("RelationId")
    sample = collections.Counter()
    for line in _sample_lines("MAPPINGS"):
        s, pp, o = (int(x) for x in line[1:-1].split(","))
        sample[(e[s], p[pp], e[o])] += 1
    ours = collections.Counter((r.s, r.p, r.o) for r in uri_triples(graph).collect())
    assert sample == ours


def test_literal_encoding_keeps_literals(graph):
    ent, rel = entity_dictionary(graph), relation_dictionary(graph)
    enc = encode_literal(literal_triples(graph), ent, rel)
    assert enc.count() == 622
    assert enc.where(F.col("s").isNull() | F.col("p").isNull()).count() == 0


def test_readable_output_equals_both_samples(graph):
    lit = literal_triples(graph).select(readable_text(graph).alias("v"))
    uri = uri_triples(graph).select(readable_text(graph).alias("v"))
    assert collections.Counter(r.v for r in lit.collect()) == collections.Counter(_sample_lines("Literals"))
    assert collections.Counter(r.v for r in uri.collect()) == collections.Counter(_sample_lines("Triples with URI"))


def test_encode_graph_job(spark, tmp):
    outs = encode_graph(spark, SAMPLE, tmp + "/out")
    assert spark.read.text(outs["entity_ids"]).count() == 305
    assert spark.read.text(outs["relation_ids"]).count() == 9
    assert spark.read.text(outs["uri_mappings"]).count() == 378
    lits = spark.read.text(outs["literal_mappings"]).collect()
    assert len(lits) == 622 and any('"Absalon"@en' in r.value for r in lits)


def test_cli_encode_graph_readable(spark, tmp):
    from kgprep.__main__ import main
    outs = main(["encode-graph", SAMPLE, "--out", tmp + "/cli", "--readable"])
    lines = [r.value for r in spark.read.text(outs["literals"]).collect()]
    assert collections.Counter(lines) == collections.Counter(_sample_lines("Literals"))
    uri = [r.value for r in spark.read.text(outs["uri_triples"]).collect()]
    assert collections.Counter(uri) == collections.Counter(_sample_lines("Triples with URI"))
    assert spark.read.text(outs["blank_nodes"]).count() == 0


def test_read_tuples_and_decode_sample_with_spark(spark, graph):
    from kgprep.schema import ENCODED, ENTITY_DICT, RELATION_DICT
    from kgprep.sources import read_tuples
    ent = read_tuples(spark, os.path.join(REFERENCE, "EntityId"), ENTITY_DICT)
    rel = read_tuples(spark, os.path.join(REFERENCE, "RelationId"), RELATION_DICT)
    enc = read_tuples(spark, os.path.join(REFERENCE, "MAPPINGS"), ENCODED)
    assert ent.count() == 305 and sorted(r.id for r in ent.collect()) == list(range(305))
    assert ent.where(F.col("entity").contains(",")).count() >= 2  # commas inside URIs survive
    assert rel.count() == 9 and enc.count() == 378
    e = ent.withColumnRenamed("entity", "uri")
    decoded = (enc.join(e.withColumnRenamed("uri", "su").withColumnRenamed("id", "s"), "s")
               .join(e.withColumnRenamed("uri", "ou").withColumnRenamed("id", "o"), "o")
               .join(rel.withColumnRenamed("relation", "pu").withColumnRenamed("id", "p"), "p")
               .select("su", "pu", "ou"))
    ours = uri_triples(graph).select(F.col("s").alias("su"), F.col("p").alias("pu"), F.col("o").alias("ou"))
    assert decoded.exceptAll(ours).count() == 0 and ours.exceptAll(decoded).count() == 0
