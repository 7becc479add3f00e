"""A small hand-written graph through the whole chain: ids are arbitrary, so
decoded triples and id ranges are compared, and the readable text."""

import collections

import pytest

from kgprep.operators import encode_literal, encode_uri, entity_dictionary, literal_triples, relation_dictionary, uri_triples
from kgprep.plans.jobs import encode_graph
from kgprep.sinks.text import readable_text
from kgprep.sources import read_ntriples, read_tuples

X, RDF, DC = "http://x.org/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/elements/1.1/"
DATE = "http://www.w3.org/2001/XMLSchema#date"
URIS = [("Ada,_(b._1815)", f"{RDF}type", "Person"), ("Ada,_(b._1815)", f"{X}knows", "Charles"),
        ("Charles", f"{X}knows", "Ada,_(b._1815)"), ("Charles", f"{RDF}type", "Person"),
        ("Çelebi", f"{RDF}type", "Person"), ("Çelebi", f"{RDF}type", "Person")]
LITERALS = [("Ada,_(b._1815)", f"{X}name", '"Ada"', "@en"), ("Charles", f"{X}born", '"1791-12-26"', f"^^<{DATE}>"),
            ("Çelebi", f"{DC}title", '"a \\"great\\" man, or\\ttwo"', "")]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("graph") / "small.nt"
    lines = ["# a comment", ""]
    lines += [f"<{X}{s}> <{p}> <{X}{o}> ." for s, p, o in URIS]
    lines += [f"<{X}{s}> <{p}> {lex}{tail} ." for s, p, lex, tail in LITERALS]
    lines += [f"_:b1 <{X}knows> <{X}Charles> .", f"<{X}Charles> <{X}knows> _:b1 ."]
    file.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(file)


@pytest.fixture(scope="module")
def graph(spark, path):
    return read_ntriples(spark, path, scope_blank_nodes=False).cache()


def _bag(rows):
    return collections.Counter(tuple(r) for r in rows)


URI_BAG = _bag((X + s, p, X + o) for s, p, o in URIS)


def test_counts_and_dense_ids(graph):
    assert graph.count() == len(URIS) + len(LITERALS) + 2
    ent, rel = entity_dictionary(graph).collect(), relation_dictionary(graph).collect()
    assert {r.entity for r in ent} == {X + n for n in ("Ada,_(b._1815)", "Charles", "Çelebi", "Person")}
    assert {r.relation for r in rel} == {f"{RDF}type", f"{X}knows", f"{X}name", f"{X}born", f"{DC}title"}
    assert sorted(r.id for r in ent) == list(range(4)) and sorted(r.id for r in rel) == list(range(5))


def test_encode_decode_is_identity(graph):
    ent, rel = entity_dictionary(graph), relation_dictionary(graph)
    e, p = {r.id: r.entity for r in ent.collect()}, {r.id: r.relation for r in rel.collect()}
    enc = encode_uri(uri_triples(graph), ent, rel).collect()
    assert _bag((e[r.s], p[r.p], e[r.o]) for r in enc) == URI_BAG
    lit = encode_literal(literal_triples(graph), ent, rel).collect()
    assert _bag((e[r.s], p[r.p], r.o, r.o_lang, r.o_datatype) for r in lit) == _bag([
        (f"{X}Ada,_(b._1815)", f"{X}name", "Ada", "en", None), (f"{X}Charles", f"{X}born", "1791-12-26", None, DATE),
        (f"{X}Çelebi", f"{DC}title", 'a "great" man, or\ttwo', None, None)])


READABLE_LITERALS = [f'{X}Ada,_(b._1815) @{X}name "Ada"@en', f'{X}Charles @{X}born "1791-12-26"^^{DATE}',
                     f'{X}Çelebi @dc:title "a \\"great\\" man, or\ttwo"']


def test_readable_text(graph):
    got = literal_triples(graph).select(readable_text(graph).alias("v")).collect()
    assert sorted(r.v for r in got) == sorted(READABLE_LITERALS)
    got = uri_triples(graph).select(readable_text(graph).alias("v")).collect()
    assert f"{X}Charles @rdf:type {X}Person" in {r.v for r in got}


def test_job_and_command_line(spark, path, tmp):
    from kgprep.__main__ import main
    from kgprep.schema import ENCODED, ENTITY_DICT, RELATION_DICT
    out = encode_graph(spark, path, tmp + "/job")
    ent, rel = read_tuples(spark, out["entity_ids"], ENTITY_DICT), read_tuples(spark, out["relation_ids"], RELATION_DICT)
    enc = read_tuples(spark, out["uri_mappings"], ENCODED)
    e, p = {r.id: r.entity for r in ent.collect()}, {r.id: r.relation for r in rel.collect()}
    assert _bag((e[r.s], p[r.p], e[r.o]) for r in enc.collect()) == URI_BAG
    outs = main(["encode-graph", path, "--out", tmp + "/cli", "--readable"])
    assert sorted(r.value for r in spark.read.text(outs["literals"]).collect()) == sorted(READABLE_LITERALS)
    assert spark.read.text(outs["blank_nodes"]).count() == 2
