"""sameAs merging (FIXTURES 2.5), TSV sources (2.2), language tree (2.3), sinks."""

import bz2
import os
import random

import pytest

from kgprep.operators import (component_labels, encode_strict, known_links, links_as_triples, merge_ids,
                              ordered_labels, unmapped, with_links)
from kgprep.plans.jobs import encode_all_languages, encode_languages, prepare_three_tasks, prepare_two_way
from kgprep.sinks import counted_lines, write_counted, write_tuples
from kgprep.sources import read_dictionary, read_language_datasets, read_links, read_quads

CASES = [
    # name, ids, links in order, ordered fold, component
    ("pair", {"a": 5, "b": 3}, [("a", "b")], {"a": 3, "b": 3}, {"a": 3, "b": 3}),
    ("chain", {"a": 2, "b": 1, "c": 0}, [("a", "b"), ("b", "c")], {"a": 1, "b": 0, "c": 0}, {"a": 0, "b": 0, "c": 0}),
    ("chain reversed", {"a": 2, "b": 1, "c": 0}, [("b", "c"), ("a", "b")], {"a": 0, "b": 0, "c": 0},
     {"a": 0, "b": 0, "c": 0}),
    ("unknown end", {"a": 2}, [("a", "z")], {"a": 2}, {"a": 2}),
    ("self, repeated", {"a": 2, "b": 1}, [("a", "a"), ("a", "b"), ("a", "b")], {"a": 1, "b": 1}, {"a": 1, "b": 1}),
    ("empty", {"a": 2}, [], {"a": 2}, {"a": 2}),
]


def _ent(spark, ids):
    return spark.createDataFrame(list(ids.items()), "entity string, id long")


def _links(spark, links):
    return spark.createDataFrame([(s, "sameAs", o, i) for i, (s, o) in enumerate(links)],
                                 "s string, p string, o string, seq long")


@pytest.mark.parametrize("block", [1 << 16, 1])
@pytest.mark.parametrize("name,ids,links,fold,comp", CASES, ids=[c[0] for c in CASES])
def test_merge_cases(spark, name, ids, links, fold, comp, block):
    # block=1 folds one link of each component in a round
    ent, ln = _ent(spark, ids), _links(spark, links)
    got_fold = {r.entity: r.id for r in merge_ids(ent, ln, mode="ordered", order_by=["seq"],
                                                  block=block).collect()}
    got_comp = {r.entity: r.id for r in merge_ids(ent, ln, mode="component").collect()}
    assert got_fold == fold
    assert got_comp == comp


def test_components_long_chain_and_order_invariance(spark):
    import random
    n = 300
    pairs = [(i, i + 1) for i in range(n - 1)] + [(1000 + i, 1000 + i + 1) for i in range(50)]
    random.Random(3).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    labels = {r.node: r.label for r in component_labels(df).collect()}
    assert all(labels[i] == 0 for i in range(n)) and all(labels[1000 + i] == 1000 for i in range(51))


def test_ordered_fold_blocks(spark):
    # a hub touching every link, with a tiny block so the carry path is used
    pairs = [(i, 0 if i % 2 else 100, i) for i in range(1, 60)]
    df = spark.createDataFrame(pairs, "a long, b long, seq long")
    got = {r.node: r.label for r in ordered_labels(df, ["seq"], block=8).collect()}
    assert {r.node: r.label for r in ordered_labels(df, ["seq"]).collect()} == got
    # sequential reference
    val = {}
    for a, b, _ in sorted(pairs, key=lambda x: x[2]):
        m = min(val.get(a, a), val.get(b, b))
        val[a] = val[b] = m
    assert got == val


def _replay(links):
    val = {}
    for a, b in links:
        val[a] = val[b] = min(val.get(a, a), val.get(b, b))
    return val


@pytest.mark.parametrize("name,rounds", [("hub", 3), ("chain back", 1), ("random", 9)])
def test_ordered_fold_takes_rounds_by_depth_not_by_length(spark, monkeypatch, name, rounds):
    from kgprep.operators import links as L

    rnd = random.Random(5)
    # 40 blocks of 10 links; the hub's smallest neighbour comes in the middle
    pairs = {"hub": [(1000, 2000 + i if i != 200 else 5) for i in range(400)],
             "chain back": [(400 - i, 401 - i) for i in range(400)],
             "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(400)]}[name]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "seq int, a long, b long")
    folds, fold = [], L._fold_blocks
    monkeypatch.setattr(L, "_fold_blocks", lambda rows: folds.append(1) or fold(rows))
    got = ordered_labels(df, ["seq"], block=10).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.label for r in got} == _replay([p for p in pairs if p[0] != p[1]])
    # the last fold of the loop has no rows: it ends the rounds
    assert len(folds) - 1 <= rounds


def test_ordered_fold_of_a_chain_longer_than_several_blocks(spark):
    # in order, each link passes the smallest id one step on
    df = spark.createDataFrame([(i, i + 1, i) for i in range(40)], "a long, b long, seq long")
    assert {r.node: r.label for r in ordered_labels(df, ["seq"], block=10).collect()} == dict.fromkeys(range(41), 0)


def test_link_operators(spark):
    ent = _ent(spark, {"a": 0, "b": 1, "c": 2})
    rel = spark.createDataFrame([("p", 0), ("sameAs", 1)], "relation string, id long")
    ln = _links(spark, [("a", "b"), ("b", "z")]).drop("seq")
    assert [(r.s, r.o) for r in known_links(ln, ent).collect()] == [("a", "b")]
    lt = links_as_triples(ln, ent, rel, "sameAs").collect()
    assert [(r.s, r.p, r.o) for r in lt] == [(0, 1, 1)]
    assert [(r.s, r.p, r.o) for r in links_as_triples(ln, ent, 7).collect()] == [(0, 7, 1)]
    train = spark.createDataFrame([(2, 0, 0)], "s long, p long, o long")
    assert with_links(train, links_as_triples(ln, ent, rel, "sameAs")).count() == 2
    tri = spark.createDataFrame([("a", "p", "c"), ("a", "q", "c")], "s string, p string, o string")
    with pytest.raises(Exception, match="unmapped triple"):
        encode_strict(tri, ent, rel).collect()
    assert encode_strict(tri, ent, rel, on_missing="drop").count() == 1
    assert encode_strict(tri, ent, rel, on_missing="null").where("p is null").count() == 1
    um = unmapped(tri, ent, rel).collect()
    assert len(um) == 1 and um[0].p_missing and not um[0].s_missing


def _write_bz2(path, rows):
    with bz2.open(path, "wt", encoding="utf-8") as f:
        for r in rows:
            f.write("\t".join(str(x) for x in r) + "\n")


def test_tsv_sources(spark, tmp):
    d = f"{tmp}/ent"
    os.makedirs(d)
    _write_bz2(f"{d}/part-0.bz2", [("http://x/a", 0), ('http://x/"q"', 1), ("http://x/é", 2)])
    _write_bz2(f"{d}/part-1.bz2", [])
    _write_bz2(f"{d}/part-2.bz2", [("http://x/a", 3)])
    with open(f"{d}/notes.txt", "w") as f:
        f.write("ignored\t9\n")
    ent = read_dictionary(spark, d)
    assert ent.count() == 4
    from kgprep.operators import as_lookup
    lk = {r.entity: r.id for r in as_lookup(ent).collect()}
    assert lk == {"http://x/a": 3, 'http://x/"q"': 1, "http://x/é": 2}
    q = f"{tmp}/quads"
    os.makedirs(q)
    _write_bz2(f"{q}/p.bz2", [("s", "p", "o", "es")])
    assert read_quads(spark, q).collect()[0].language == "es"
    ln = f"{tmp}/links"
    os.makedirs(ln)
    _write_bz2(f"{ln}/p.bz2", [("a", "sameAs", "b")])
    assert read_links(spark, ln).count() == 1


def _tree(tmp):
    root = f"{tmp}/tree"
    files = {("en", "labels"): ["<http://x/en/a> <http://x/p> <http://x/en/b> .",
                                '<http://x/en/a> <http://x/name> "A"@en .'],
             ("en", "types"): ["<http://x/en/a> <http://x/type> <http://x/C> .", "_:b <http://x/p> <http://x/en/a> ."],
             ("es", "labels"): ["<http://x/es/a> <http://x/p> <http://x/es/b> ."],
             ("es", "other"): ["<http://x/es/z> <http://x/p> <http://x/es/y> ."]}
    for (lang, ds), lines in files.items():
        os.makedirs(f"{root}/{lang}", exist_ok=True)
        with bz2.open(f"{root}/{lang}/{ds}_{lang}.ttl.bz2", "wt", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return root


def test_language_tree(spark, tmp):
    root = _tree(tmp)
    # a "file" may also be a Hadoop output directory of parts
    os.makedirs(f"{root}/fr/labels_fr.ttl.bz2")
    for i in range(2):
        with bz2.open(f"{root}/fr/labels_fr.ttl.bz2/part-{i}.bz2", "wt", encoding="utf-8") as f:
            f.write(f"<http://x/fr/{i}> <http://x/p> <http://x/fr/z> .\n")
    g = read_language_datasets(spark, root, ["en", "es", "fr"], ["labels", "types"])
    got = {(r.language, r.dataset) for r in g.select("language", "dataset").distinct().collect()}
    assert got == {("en", "labels"), ("en", "types"), ("es", "labels"), ("fr", "labels")}
    assert g.where("language = 'fr'").count() == 2
    g = g.where("language != 'fr'")
    assert g.where("s_kind = 'blank'").count() == 0  # lines must start with '<'
    outs = encode_languages(spark, root, f"{tmp}/w2", ["en", "es"], ["labels", "types"])
    ents = spark.read.text(outs["entity_ids"]).collect()
    assert {r.language for r in ents} == {"en", "es"}
    assert len([r for r in ents if r.language == "es"]) == 2
    outs3 = encode_all_languages(spark, root, f"{tmp}/w3", ["en", "es"], ["labels", "types"])
    assert spark.read.text(outs3["uri_mappings"]).count() == 3


def test_counted_and_tuples(spark, tmp):
    df = spark.range(0, 1000, 1, 8).selectExpr("concat('e', id) AS entity", "id")
    write_counted(df, f"{tmp}/c", order_by=["id"])
    parts = sorted(p for p in os.listdir(f"{tmp}/c") if p.startswith("part-"))
    text = "".join(open(f"{tmp}/c/{p}").read() for p in parts).splitlines()
    assert text[0] == "1000" and text[1] == "e0\t0" and text[-1] == "e999\t999"
    assert counted_lines(df.limit(0)).collect()[0].value == "0"
    from kgprep.sinks import write_tsv
    write_tsv(df, f"{tmp}/sorted", order_by=["id"])
    parts = sorted(p for p in os.listdir(f"{tmp}/sorted") if p.startswith("part-"))
    ids = [int(x.split("\t")[1]) for p in parts for x in open(f"{tmp}/sorted/{p}").read().splitlines()]
    assert ids == list(range(1000))
    write_tuples(spark.createDataFrame([("http://x/a,b(c)", 1)], "entity string, id long"), f"{tmp}/t")
    line = spark.read.text(f"{tmp}/t").collect()[0].value
    assert line == "(http://x/a,b(c),1)" and line[1:-1].rsplit(",", 1) == ["http://x/a,b(c)", "1"]


def test_prepare_jobs(spark, tmp):
    src = f"{tmp}/src"
    for sub in ("quads", "entity2id", "relation2id", "links", "es_entity2id", "es_relation2id"):
        os.makedirs(f"{src}/{sub}")
    quads = [(f"e{i}", f"p{i % 2}", f"e{(i + 1) % 20}", "es" if i < 12 else "ja") for i in range(20)]
    _write_bz2(f"{src}/quads/a.bz2", quads)
    _write_bz2(f"{src}/entity2id/a.bz2", [(f"e{i}", i) for i in range(20)])
    _write_bz2(f"{src}/relation2id/a.bz2", [("p0", 0), ("p1", 1)])
    _write_bz2(f"{src}/links/a.bz2", [("e1", "owl:sameAs", "e15"), ("e2", "owl:sameAs", "e16"), ("e3", "owl:sameAs", "zz")])
    _write_bz2(f"{src}/es_entity2id/a.bz2", [(f"e{i}", i) for i in range(14)])
    _write_bz2(f"{src}/es_relation2id/a.bz2", [("p0", 0), ("p1", 1)])
    prepare_three_tasks(spark, src, f"{tmp}/w5", language="es", seed="1")
    lines = spark.read.text(f"{tmp}/w5/triple2id_ex1").collect()
    n_train = 8 + 5  # floor(0.7*12) + floor(0.7*8)
    assert len(lines) == 1 + n_train + 2  # count line, train, two known links
    rel = [r.value for r in spark.read.text(f"{tmp}/w5/relation2id").collect()]
    assert "http://www.w3.org/2002/07/owl#sameAs\t2" in rel
    merged = dict(r.value.split("\t") for r in spark.read.text(f"{tmp}/w5/modified_entity2id").collect()
                  if "\t" in r.value)
    assert merged["e15"] == "1" and merged["e16"] == "2"
    prepare_two_way(spark, src, f"{tmp}/w4", seed="1", merge_mode="ordered")
    assert spark.read.text(f"{tmp}/w4/test2id_ex1").count() == 12 - 9 + 8 - 6
    parts = sorted(p for p in os.listdir(f"{tmp}/w4/entity2id") if p.startswith("part-"))
    first = open(f"{tmp}/w4/entity2id/{parts[0]}").readline().strip()
    assert first == "20"  # the count line heads the concatenated parts


def test_language_tree_paths(spark, tmp):
    for lang, name in (("zh_min_nan", "labels_zh_min_nan.ttl"), ("en", "long_abstracts_en.nt")):
        os.makedirs(f"{tmp}/{lang}", exist_ok=True)
        with open(f"{tmp}/{lang}/{name}", "w") as f:
            f.write("<http://x/a> <http://x/p> <http://x/b> .\n")
    g = read_language_datasets(spark, tmp, ["zh_min_nan"], suffix=".ttl")
    assert [(r.language, r.dataset) for r in g.collect()] == [("zh_min_nan", "labels")]
    g = read_language_datasets(spark, tmp, ["en"], suffix=".nt")
    assert [(r.language, r.dataset) for r in g.collect()] == [("en", "long_abstracts")]
    with open(f"{tmp}/en/labels_de.nt", "w") as f:
        f.write("<http://x/a> <http://x/p> <http://x/b> .\n")
    with pytest.raises(Exception, match="not a <language>"):
        read_language_datasets(spark, tmp, ["en"], suffix=".nt").collect()


def test_broken_tuple_line_raises(spark, tmp):
    from kgprep.schema import ENTITY_DICT
    from kgprep.sources import read_tuples
    with open(f"{tmp}/t.txt", "w") as f:
        f.write("(http://x/a,b,1)\nbroken\n")
    with pytest.raises(Exception, match="malformed tuple line"):
        read_tuples(spark, f"{tmp}/t.txt", ENTITY_DICT).collect()


def test_null_field_stays_a_field(spark, tmp):
    from kgprep.sinks import write_tsv
    df = spark.createDataFrame([(1, None, 3)], "s long, p long, o long")
    write_tsv(df, f"{tmp}/tsv")
    write_tuples(df, f"{tmp}/tuples")
    assert spark.read.text(f"{tmp}/tsv").collect()[0].value == "1\t\t3"
    assert spark.read.text(f"{tmp}/tuples").collect()[0].value == "(1,,3)"


def test_literal_mappings_read_back(spark, tmp):
    from kgprep.sources import read_literal_mappings
    path = f"{tmp}/g.nt"
    with open(path, "w", encoding="utf-8") as f:
        f.write('<http://x/s> <http://x/p> "a, \\"b\\"\\n(c),1"@en .\n<http://x/s> <http://x/p> "3"^^<http://t#int> .\n'
                '<http://x/s> <http://x/q> "" .\n')
    from kgprep.plans.jobs import encode_graph
    out = encode_graph(spark, path, f"{tmp}/out")
    got = {(r.o, r.o_lang, r.o_datatype) for r in read_literal_mappings(spark, out["literal_mappings"]).collect()}
    assert got == {('a, "b"\n(c),1', "en", None), ("3", None, "http://t#int"), ("", None, None)}


def test_counted_write_keeps_the_callers_cache(spark, tmp):
    df = spark.range(10).selectExpr("concat('e', id) AS entity", "id").cache()
    before = df.storageLevel
    write_counted(df, f"{tmp}/c")
    assert df.storageLevel == before and before.useMemory
    df.unpersist()


def test_layout_has_few_files(spark, tmp):
    from kgprep.sinks import write_language_outputs
    df = spark.range(0, 4000, 1, 40).selectExpr("id AS s", "id AS p", "id AS o", "concat('l', id % 5) AS language")
    write_language_outputs(df, f"{tmp}/k5")
    files = [f for _, _, names in os.walk(f"{tmp}/k5") for f in names if f.startswith("part-")]
    assert len(files) <= 10 and spark.read.text(f"{tmp}/k5").count() == 4000
