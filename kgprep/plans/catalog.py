"""Registered queries: one per operator of the inventory, each on inputs
derived from the whole driver tables.  ``QUERIES[name](spark, sf_dir)``
returns a DataFrame; ``kgprep.plans.oracle.ORACLES[name]`` is the DuckDB
SQL for the same result.  File operators write to a fresh folder under the
shared checkpoint folder and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgprep.functions.nodes import escape_literal, literal_parts, literal_text, node_kind, split_statement
from kgprep.operators import encode as J
from kgprep.operators import filters as Fl
from kgprep.operators import ids as D
from kgprep.operators import links as A
from kgprep.operators import splits as X
from kgprep.plans import derived as dv
from kgprep.plans.fixtures import write_language_tree
from kgprep.schema import OWL_SAME_AS
from kgprep.session import scratch_path
from kgprep.sinks import text as K
from kgprep.sources import ntriples as S
from kgprep.sources import quarantine as Q
from kgprep.sources import tsv as T

BATCH_DATE = "1998-01-01"
FILE_LINES = 1_000_000

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return S.parse_ntriples(dv.ntriples_lines(spark, sf), **kw)


def _ent_g(spark, sf):
    return D.entity_dictionary(dv.graph(spark, sf))


def _rel_g(spark, sf):
    return D.relation_dictionary(dv.graph(spark, sf))


def _ent_q(spark, sf):
    return D.entity_dictionary(dv.quads(spark, sf))


def _rel_qs(spark, sf):
    return D.append_relation(D.relation_dictionary(dv.quads(spark, sf)), OWL_SAME_AS)


def _split3(spark, sf):
    return X.split(dv.quads(spark, sf), "language", X.TRAIN_VALID_TEST, seed=dv.SEED)


def _merged_star(spark, sf):
    return A.merge_ids(_ent_q(spark, sf), dv.star_links(spark, sf), mode="component")


def _enc_g(spark, sf):
    g = dv.graph(spark, sf)
    return J.encode_uri(Fl.uri_triples(g), _ent_g(spark, sf), _rel_g(spark, sf))


def _enc_g_heavy(spark, sf):
    # objects holding >= 0.1 % of the URI triples (nations, customers with
    # many orders) are split off and broadcast-joined; the rest is shuffled
    g = dv.graph(spark, sf)
    return J.encode_uri(Fl.uri_triples(g), _ent_g(spark, sf), _rel_g(spark, sf), skew_share=0.001)


def _lang_dicts(spark, sf, lang):
    q = dv.quads(spark, sf)
    ent = D.entity_dictionary(q, scope="language").where(F.col("language") == lang).drop("language")
    rel = D.relation_dictionary(q, scope="language").where(F.col("language") == lang).drop("language")
    return ent, rel


def _s2(spark, sf):
    path = scratch_path(spark, "s2-ntriples")
    K.write_bzip2(dv.ntriples_lines(spark, sf), path)
    return S.read_ntriples(spark, f"{path}/*.bz2", scope_blank_nodes=False)


def _language_tree(spark, sf, name):
    """Quads as N-Triples files ``<lang>/<source>_<lang>.ttl.bz2``."""
    root = scratch_path(spark, name)
    q = dv.quads(spark, sf)
    lines = q.select("language", F.regexp_extract("o", "[^/]*$", 0).alias("dataset"),
                     F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> <"), "o", F.lit("> .")).alias("value"))
    write_language_tree(lines, root)
    return root


def _s4(spark, sf):
    root = _language_tree(spark, sf, "s4-tree")
    g = S.read_language_datasets(spark, root)
    return g.select("s", "p", "o", "language", "dataset")


def _s6(spark, sf):
    path = scratch_path(spark, "s6-dict")
    K.write_tsv(_ent_q(spark, sf), path, compression="bzip2")
    return T.read_dictionary(spark, path, "entity")


def _s7(spark, sf):
    path = scratch_path(spark, "s7-quads")
    K.write_tsv(dv.quads(spark, sf), path, compression="bzip2")
    return T.read_quads(spark, path)


def _s8(spark, sf):
    path = scratch_path(spark, "s8-links")
    K.write_tsv(dv.star_links(spark, sf), path, compression="bzip2")
    return T.read_links(spark, path)


def _n1(spark, sf):
    parts = dv.ntriples_lines(spark, sf).select(split_statement("value").alias("x"))
    kinds = parts.select(node_kind(F.get(F.col("x"), 0)).alias("s_kind"), node_kind(F.get(F.col("x"), 2)).alias("o_kind"))
    return kinds.groupBy("s_kind", "o_kind").agg(F.count(F.lit(1)).alias("n"))


def _n2(spark, sf):
    x = dv.ntriples_lines(spark, sf).select(split_statement("value").alias("x"))
    x = x.select(F.get(F.col("x"), 0).alias("sr"), F.get(F.col("x"), 1).alias("pr"), F.get(F.col("x"), 2).alias("orw"))
    lit = x.where(node_kind("orw") == "literal").select("sr", "pr", literal_parts("orw").alias("lp"))
    return lit.select(F.expr("substring(sr, 2, length(sr) - 2)").alias("s"), F.expr("substring(pr, 2, length(pr) - 2)").alias("p"),
                      F.get(F.col("lp"), 0).alias("lexical"), F.nullif(F.get(F.col("lp"), 1), F.lit("")).alias("o_lang"),
                      F.nullif(F.get(F.col("lp"), 2), F.lit("")).alias("o_datatype"))


def _d7(spark, sf):
    q = dv.quads(spark, sf)
    both = D.entity_dictionary(q).unionByName(D.entity_dictionary(q, scope="language").drop("language"))
    return D.as_lookup(both, "entity")


def _j6(spark, sf):
    q = dv.quads(spark, sf)
    return J.encode_uri(q, D.entity_dictionary(q, scope="language"), D.relation_dictionary(q, scope="language"),
                        scope="language")


def _j8_unmapped(spark, sf):
    ent, rel = _lang_dicts(spark, sf, "en")
    return J.unmapped(dv.quads(spark, sf), ent, rel)


def _train(spark, sf):
    return X.joint(_split3(spark, sf), "train")


def _a3(spark, sf):
    ent, rel = _ent_q(spark, sf), _rel_qs(spark, sf)
    train = J.encode_strict(_train(spark, sf), ent, rel)
    return A.with_links(train, A.links_as_triples(dv.star_links(spark, sf), ent, rel))


def _a8(spark, sf):
    es_test = X.language_part(_split3(spark, sf), "es", "test")
    rel = _rel_qs(spark, sf)
    own_ent, own_rel = _lang_dicts(spark, sf, "es")
    return (J.encode_strict(es_test, _ent_q(spark, sf), rel).select(F.lit("joint").alias("dictionary"), "s", "p", "o")
            .unionByName(J.encode_strict(es_test, _merged_star(spark, sf), rel)
                         .select(F.lit("merged").alias("dictionary"), "s", "p", "o"))
            .unionByName(J.encode_strict(es_test, own_ent, own_rel).select(F.lit("own").alias("dictionary"), "s", "p", "o")))


def _k1(spark, sf):
    path = scratch_path(spark, "k1-tuples")
    K.write_tuples(_enc_g(spark, sf), path)
    return spark.read.text(path)


def _k1_back(spark, sf):
    from kgprep.schema import ENTITY_DICT
    path = scratch_path(spark, "k1-dict")
    K.write_tuples(_ent_g(spark, sf), path, ["entity", "id"])
    return T.read_tuples(spark, path, ENTITY_DICT)


def _k2(spark, sf):
    path = scratch_path(spark, "k2-tsv")
    K.write_tsv(dv.quads(spark, sf).select("s", "p", "o"), path)
    return spark.read.text(path)


def _k3(spark, sf):
    path = scratch_path(spark, "k3-counted")
    K.write_counted(_ent_q(spark, sf), path, order_by=["id"])
    return spark.read.text(path)


def _k4(spark, sf):
    path = scratch_path(spark, "k4-readable")
    K.write_readable(dv.graph(spark, sf), path)
    return spark.read.text(path)


def _k5(spark, sf):
    path = scratch_path(spark, "k5-layout")
    q = dv.quads(spark, sf).withColumn("dataset", F.regexp_extract("o", "[^/]*$", 0))
    enc = J.encode_uri(q, D.entity_dictionary(q, scope="language"), D.relation_dictionary(q, scope="language"),
                       scope="language", keep=["dataset"])
    K.write_language_outputs(enc, path)
    return spark.read.option("basePath", path).text(path).select(
        "value", F.col("language").cast("string").alias("language"), F.col("dataset").cast("string").alias("dataset"))


def _outputs(spark, root, names):
    """All outputs of a job as text lines: output, value."""
    parts = [spark.read.text(f"{root}/{n}").select(F.lit(n).alias("output"), "value") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


W1_OUTPUTS = ("entity_ids", "relation_ids", "uri_mappings", "literal_mappings", "literals", "blank_nodes", "uri_triples")
W3_OUTPUTS = ("entity_ids", "relation_ids", "uri_mappings")
W4_OUTPUTS = ("entity2id", "relation2id", "URI_joint_train", "URI_joint_test", "triple2id_ex1", "test2id_ex1",
              "modified_entity2id", "triple2id_ex2", "test2id_ex2")
W5_OUTPUTS = ("entity2id", "relation2id", "sameAs_URI", "URI_joint_train", "URI_joint_valid", "URI_joint_test",
              "es_train_URI", "es_valid_URI", "es_test_URI", "triple2id_ex1", "valid2id_ex1", "test2id_ex1",
              "es_test_original_mappings", "modified_entity2id", "triple2id_ex2", "valid2id_ex2", "test2id_ex2",
              "es_test_new_mappings", "es_entity2id", "es_relation2id", "es_train", "es_valid", "es_test")


def _w1(spark, sf):
    from kgprep.plans.jobs import encode_graph
    out = scratch_path(spark, "w1")
    lines = scratch_path(spark, "w1-input")
    # as plain text the lines and the outputs take a hundred times the tables' bytes
    K._write_lines(dv.ntriples_lines(spark, sf), lines, "overwrite", "gzip", file_lines=FILE_LINES)
    encode_graph(spark, f"{lines}/*.txt.gz", out, scope_blank_nodes=False, readable=True, compression="gzip")
    return _outputs(spark, out, W1_OUTPUTS)


def _w2(spark, sf):
    from kgprep.plans.jobs import encode_languages
    outs = encode_languages(spark, _language_tree(spark, sf, "w2-tree"), scratch_path(spark, "w2"))
    parts = []
    for name in ("entity_ids", "relation_ids", "uri_mappings"):
        rows = spark.read.option("basePath", outs[name]).text(outs[name])
        dataset = F.col("dataset").cast("string") if "dataset" in rows.columns else F.lit(None).cast("string")
        parts.append(rows.select(F.lit(name).alias("output"), F.col("language").cast("string").alias("language"),
                                 dataset.alias("dataset"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _w3(spark, sf):
    from kgprep.plans.jobs import encode_all_languages
    out = scratch_path(spark, "w3")
    encode_all_languages(spark, _language_tree(spark, sf, "w3-tree"), out)
    return _outputs(spark, out, W3_OUTPUTS)


def _export(spark, sf, name, *more):
    """Inputs of W4 and W5 in the layouts that they read, written by the export job."""
    from kgprep.plans.jobs import export_inputs
    src = scratch_path(spark, name)
    q = dv.quads(spark, sf)
    g = q.select("s", F.lit("uri").alias("s_kind"), "p", "o", F.lit("uri").alias("o_kind"), "language")
    export_inputs(g, dv.star_links(spark, sf), src, languages=more)
    return src


def _w4(spark, sf, mode="component"):
    from kgprep.plans.jobs import prepare_two_way
    out = scratch_path(spark, "w4")
    prepare_two_way(spark, _export(spark, sf, "w4-input"), out, seed=dv.SEED, merge_mode=mode)
    return _outputs(spark, out, W4_OUTPUTS)


def _w5(spark, sf, mode="component"):
    from kgprep.plans.jobs import prepare_three_tasks
    out = scratch_path(spark, "w5")
    prepare_three_tasks(spark, _export(spark, sf, "w5-input", "es"), out, language="es", seed=dv.SEED, merge_mode=mode)
    return _outputs(spark, out, W5_OUTPUTS)


def _escaped(text):
    """Every character beyond ASCII as a numbered escape, and the rest as a literal needs it."""
    chars = F.split(escape_literal(text), "")
    return F.array_join(F.transform(chars, lambda c: F.when(
        F.octet_length(c) > 1, F.concat(F.lit("\\u"), F.hex(F.encode(c, "UTF-16BE")))).otherwise(c)), "")


def _s1_text(spark, sf, render):
    """Whole document texts as literals and document ids in the subjects, parsed back."""
    d = dv.table(spark, sf, "documents")
    lines = d.select(F.concat(F.lit(f"<{dv.BASE}doc/"), F.col("doc_id").cast("string"), F.lit(f"> <{dv.BASE}text> \""),
                              render(F.col("text")), F.lit('"@'), F.col("lang"), F.lit(" .")).alias("value"))
    return S.parse_ntriples(lines).select("s", "o", "o_lang")


def _spoiled(spark, sf):
    """Orders as N-Triples files, some lines malformed in each way, empty or a comment; scanned with a quarantine."""
    key = F.col("o_orderkey").cast("string")
    s, p, o = F.concat(F.lit(f"<{dv.BASE}order/"), key, F.lit(">")), F.lit(f" <{dv.BASE}p> "), F.lit(f"<{dv.BASE}o>")
    line = F.concat(s, p, o)
    spoiled = [line, F.concat(key, p, o, F.lit(" .")), F.concat(s, F.lit(" _:p "), o, F.lit(" .")),
               F.concat(s, p, key, F.lit(" .")), F.concat(s, p, F.lit('"\\q" .')), F.concat(F.lit("# "), key), F.lit("")]
    value = F.concat(line, F.lit(" ."))
    for i, bad in enumerate(spoiled):
        value = F.when(F.col("o_orderkey") % 50 == i, bad).otherwise(value)
    path = scratch_path(spark, "spoiled")
    dv.table(spark, sf, "orders").select(value.alias("value")).write.option("compression", "bzip2").text(path)
    return Q.read_with_quarantine(spark, f"{path}/*.bz2")


def _s1_line_counts(spark, sf):
    return _spoiled(spark, sf).counts.agg(*[F.sum(c).alias(c) for c in ("lines", "triples", "rejected", "skipped")])


def _s1_escaped_iris(spark, sf):
    """Sources named in two spellings, with and without escapes: one entity for both."""
    d = dv.table(spark, sf, "documents").select(F.concat(F.lit("é-"), "lang", F.lit("-"), "source").alias("n"))
    lines = d.select(F.explode(F.array("n", _escaped(F.col("n")))).alias("n")).select(F.concat(
        F.lit(f"<{dv.BASE}"), "n", F.lit(f"> <{dv.BASE}p> <{dv.BASE}o> .")).alias("value"))
    return D.entities(S.parse_ntriples(lines))


def _some_null(spark, sf):
    """Quads of which those of one language have lost it."""
    return dv.quads(spark, sf).withColumn("language", F.when(F.col("language") != "es", F.col("language")))


def _hub_links(spark, sf):
    o = dv.table(spark, sf, "orders")
    return o.select(F.lit(f"{dv.BASE}region/0").alias("s"), F.lit(OWL_SAME_AS).alias("p"),
                    dv.uri("order", "o_orderkey").alias("o"))


def _k1_literals_back(spark, sf):
    path = scratch_path(spark, "k1-literals")
    g = dv.graph(spark, sf)
    enc = J.encode_literal(Fl.literal_triples(g), _ent_g(spark, sf), _rel_g(spark, sf))
    K.write_tuples(enc.withColumn("o", literal_text("o", "o_lang", "o_datatype")), path, ["s", "p", "o"])
    return T.read_literal_mappings(spark, path)


def _customers_of(orders):
    return orders.select(dv.uri("customer", "o_custkey").alias("entity"))


def _d3_grow(spark, sf):
    """Customers in the order in which they first order: one batch before a date, one from it on."""
    o = dv.table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit(BATCH_DATE).cast("timestamp")
    first = D.dense_ids(_customers_of(o.where(early)).distinct(), "entity")
    return D.grow_dictionary(first, _customers_of(o.where(~early)))


def _a5_grow(spark, sf):
    """Chain links in two batches, by the date of the order that a link leaves: the second grows the first's components."""
    ent = _ent_g(spark, sf).checkpoint()
    o = dv.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderdate")
    links = dv.chain_links(spark, sf).join(o, "seq")
    # the ids of all links are looked up once
    pairs = A.link_id_pairs(links, ent, keep=["o_orderdate"]).select("o_orderdate", "a", "b").checkpoint()
    early = F.col("o_orderdate") < F.lit(BATCH_DATE).cast("timestamp")
    labels = A.component_labels(pairs.where(early))
    labels = A.grow_components(labels, pairs.where(~early))
    return ent.join(labels, ent["id"] == labels["node"], "left").select("entity", F.coalesce("label", "id").alias("id"))


def _x4_repeated(spark, sf):
    """Order lines reduced to few different rows, most of them repeated often."""
    rows = dv.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("s"), F.lit("p").alias("p"), F.col("l_linestatus").alias("o"),
        F.col("l_returnflag").alias("language"))
    return X.split(rows, "language", X.TRAIN_VALID_TEST, seed=dv.SEED)


def _j8_many(spark, sf):
    """Every quad under all dictionaries at once; Spanish ones also under their own."""
    q = dv.quads(spark, sf)
    own = Fl.language_rows(q, "es")
    many = J.encode_many(
        q, J.id_table({"given": _ent_q(spark, sf), "merged": _merged_star(spark, sf), "own": D.entity_dictionary(own)}),
        J.id_table({"given": _rel_qs(spark, sf), "own": D.relation_dictionary(own)}, "relation"), keep=["language"])
    spanish = many.where("language = 'es'")
    parts = [J.encoded(many, "given", "given", keep=["language"]), J.encoded(many, "merged", "given", keep=["language"]),
             J.encoded(spanish, "own", "own", keep=["language"])]
    parts = [x.select(F.lit(name).alias("dictionary"), "*") for name, x in zip(("given", "merged", "own"), parts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES: dict[str, Query] = {
    "s1_parse_ntriples": lambda sp, sf: _parsed(sp, sf),
    "s2_read_bz2_ntriples": _s2,
    "s3_uri_subject_lines": lambda sp, sf: _parsed(sp, sf, uri_subjects_only=True),
    "s4_language_datasets": _s4,
    "s6_read_dictionary": _s6,
    "s7_read_quads": _s7,
    "s8_read_links": _s8,
    "n1_node_kinds": _n1,
    "n2_literal_parts": _n2,
    "f1_literal_object": lambda sp, sf: Fl.literal_object(_parsed(sp, sf)),
    "f2_uri_subject": lambda sp, sf: Fl.uri_subject(_parsed(sp, sf)),
    "f3_literal_triples": lambda sp, sf: Fl.literal_triples(_parsed(sp, sf)),
    "f4_uri_triples": lambda sp, sf: Fl.uri_triples(_parsed(sp, sf)),
    "f5_blank_triples": lambda sp, sf: Fl.blank_triples(_parsed(sp, sf)),
    "p1_subjects": lambda sp, sf: Fl.subjects(dv.graph(sp, sf)),
    "p1_objects": lambda sp, sf: Fl.objects(dv.graph(sp, sf)),
    "p1_predicates": lambda sp, sf: Fl.predicates(dv.graph(sp, sf)),
    "p2_as_spo": lambda sp, sf: Fl.as_spo(Fl.uri_triples(dv.graph(sp, sf))),
    "p3_drop_language": lambda sp, sf: Fl.drop_language(dv.quads(sp, sf)),
    "p4_language_rows": lambda sp, sf: Fl.language_rows(dv.quads(sp, sf), ["es", "fr"]),
    "d1_entities": lambda sp, sf: D.entities(dv.graph(sp, sf)),
    "d2_relations": lambda sp, sf: D.relations(dv.graph(sp, sf)),
    "d3_dense_ids": lambda sp, sf: D.dense_ids(dv.graph(sp, sf).select(F.col("s").alias("key")).distinct(), "key"),
    "d4_entity_dictionary": _ent_g,
    "d4_relation_dictionary": _rel_g,
    "d5_entity_dictionary_by_language": lambda sp, sf: D.entity_dictionary(dv.quads(sp, sf), scope="language"),
    "d5_relation_dictionary_by_language": lambda sp, sf: D.relation_dictionary(dv.quads(sp, sf), scope="language"),
    "d6_entity_dictionary_all_languages": _ent_q,
    "d7_as_lookup": _d7,
    "d8_sorted_by_id": lambda sp, sf: D.sorted_by_id(_ent_g(sp, sf)),
    "d9_append_relation": _rel_qs,
    "j4_encode_uri": _enc_g,
    "j4_encode_uri_heavy_split": _enc_g_heavy,
    "j5_encode_literal": lambda sp, sf: J.encode_literal(Fl.literal_triples(dv.graph(sp, sf)), _ent_g(sp, sf),
                                                         _rel_g(sp, sf)),
    "j6_encode_by_language": _j6,
    "j7_encode_all_languages": lambda sp, sf: J.encode_uri(dv.quads(sp, sf), _ent_q(sp, sf),
                                                           D.relation_dictionary(dv.quads(sp, sf))),
    "j8_encode_strict": lambda sp, sf: J.encode_strict(_train(sp, sf), _ent_q(sp, sf), _rel_qs(sp, sf)),
    "j8_unmapped": _j8_unmapped,
    "x1_language_counts": lambda sp, sf: X.language_counts(dv.quads(sp, sf)),
    "x2_shuffle_rank": lambda sp, sf: X.shuffle_rank(dv.quads(sp, sf), "language", seed=dv.SEED),
    "x3_split_80_20": lambda sp, sf: X.split(dv.quads(sp, sf), "language", X.TRAIN_TEST, seed=dv.SEED),
    "x4_split_70_15_15": _split3,
    "x5_joint_train": _train,
    "x6_language_part": lambda sp, sf: X.language_part(_split3(sp, sf), "es", "test"),
    "a1_known_links": lambda sp, sf: A.known_links(dv.star_links(sp, sf), _ent_q(sp, sf)),
    "a2_links_as_triples": lambda sp, sf: A.links_as_triples(dv.star_links(sp, sf), _ent_q(sp, sf), _rel_qs(sp, sf)),
    "a3_train_with_links": _a3,
    "a4_merge_ordered": lambda sp, sf: A.merge_ids(_ent_g(sp, sf), dv.chain_links(sp, sf), mode="ordered",
                                                   order_by=["seq"]),
    "a5_merge_components": lambda sp, sf: A.merge_ids(_ent_g(sp, sf), dv.chain_links(sp, sf), mode="component"),
    "a6_merged_dictionary": _merged_star,
    "a7_reencode_merged": lambda sp, sf: J.encode_strict(_train(sp, sf), _merged_star(sp, sf), _rel_qs(sp, sf)),
    "a8_language_test_three_ways": _a8,
    "k1_write_tuples": _k1,
    "k1_read_tuples_back": _k1_back,
    "k2_write_tsv": _k2,
    "k3_write_counted": _k3,
    "k4_write_readable": _k4,
    "k5_language_outputs": _k5,
    "w1_encode_graph": _w1,
    "w2_encode_languages": _w2,
    "w3_encode_all_languages": _w3,
    "w4_two_way": _w4,
    "w4_two_way_ordered": lambda sp, sf: _w4(sp, sf, mode="ordered"),
    "w5_three_tasks": _w5,
    "w5_three_tasks_ordered": lambda sp, sf: _w5(sp, sf, mode="ordered"),
    "s1_long_literals": lambda sp, sf: _s1_text(sp, sf, escape_literal),
    "s1_escapes": lambda sp, sf: _s1_text(sp, sf, _escaped),
    "s1_escaped_iris": _s1_escaped_iris,
    "s1_quarantine": lambda sp, sf: _spoiled(sp, sf).rejected.select("line", "reason"),
    "s1_line_counts": _s1_line_counts,
    "d5_dense_ids_null_scope": lambda sp, sf: D.entity_dictionary(_some_null(sp, sf), scope="language"),
    "j6_encode_null_scope": lambda sp, sf: J.encode_uri(
        _some_null(sp, sf), D.entity_dictionary(_some_null(sp, sf), scope="language"),
        D.relation_dictionary(_some_null(sp, sf), scope="language"), scope="language"),
    "x4_split_null_language": lambda sp, sf: X.split(_some_null(sp, sf), "language", X.TRAIN_VALID_TEST, seed=dv.SEED),
    "a4_merge_ordered_in_blocks": lambda sp, sf: A.merge_ids(_ent_g(sp, sf), dv.chain_links(sp, sf), mode="ordered",
                                                             order_by=["seq"], block=8),
    "a5_merge_hub": lambda sp, sf: A.merge_ids(_ent_g(sp, sf), _hub_links(sp, sf), mode="component"),
    "k1_read_literals_back": _k1_literals_back,
    "d3_grow_dictionary": _d3_grow,
    "a5_grow_components": _a5_grow,
    "x4_split_repeated_rows": _x4_repeated,
    "j8_encode_many": _j8_many,
}
