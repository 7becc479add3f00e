"""DuckDB SQL that recomputes every registered query on the same parquet
tables (views ``customer``, ``nation``, ``orders``, ... are registered by
the checker).  Ids are ``row_number() over (order by md5(key), key) - 1``
and permutations ``md5(seed, s, p, o)`` order, so both engines agree on
values, not just on shapes.
"""

from __future__ import annotations

from kgprep.plans.derived import BASE, SEED
from kgprep.schema import OWL_SAME_AS, XSD_DATE


def _u(kind: str, col: str) -> str:
    return f"('{BASE}{kind}/' || CAST({col} AS VARCHAR))"


def _t(s: str, sk: str, p: str, o: str, ok: str, lang: str = "NULL", dt: str = "NULL") -> str:
    return (f"{s} AS s, '{sk}' AS s_kind, '{BASE}{p}' AS p, {o} AS o, '{ok}' AS o_kind, "
            f"CAST({lang} AS VARCHAR) AS o_lang, CAST({dt} AS VARCHAR) AS o_datatype")


def _dense(keys_sql: str, key: str, scope: str | None = None) -> str:
    part = f"PARTITION BY {scope} " if scope else ""
    sc = f"{scope}, " if scope else ""
    return (f"SELECT {sc}{key}, row_number() OVER ({part}ORDER BY md5({key}), {key}) - 1 AS id "
            f"FROM (SELECT DISTINCT {sc}{key} FROM ({keys_sql}))")


_BLANK = "('_:l' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR))"

def _enc(src: str, ent: str, rel: str, cols: str = "") -> str:
    """Inner-join encoding of (s, p, o) URIs in ``src``."""
    return (f"SELECT {cols}es.id AS s, r.id AS p, eo.id AS o FROM {src} x "
            f"JOIN {ent} es ON es.entity = x.s JOIN {ent} eo ON eo.entity = x.o JOIN {rel} r ON r.relation = x.p")


# name -> (sql, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "uri_t": (
        f"SELECT {_t(_u('customer', 'c_custkey'), 'uri', 'nation', _u('nation', 'c_nationkey'), 'uri')} FROM customer "
        f"UNION ALL SELECT {_t(_u('nation', 'n_nationkey'), 'uri', 'region', _u('region', 'n_regionkey'), 'uri')} FROM nation "
        f"UNION ALL SELECT {_t(_u('order', 'o_orderkey'), 'uri', 'customer', _u('customer', 'o_custkey'), 'uri')} FROM orders",
        ()),
    "lit_t": (
        f"SELECT {_t(_u('customer', 'c_custkey'), 'uri', 'name', 'c_name', 'literal', lang=repr('en'))} FROM customer "
        f"UNION ALL SELECT {_t(_u('order', 'o_orderkey'), 'uri', 'date', "strftime(o_orderdate, '%Y-%m-%d')", 'literal', dt=repr(XSD_DATE))} FROM orders",
        ()),
    "blank_t": (
        f"SELECT {_t(_BLANK, 'blank', 'order', _u('order', 'l_orderkey'), 'uri')} FROM lineitem "
        f"UNION ALL SELECT {_t(_u('order', 'l_orderkey'), 'uri', 'line', _BLANK, 'blank')} FROM lineitem",
        ()),
    "graph": ("SELECT * FROM uri_t UNION ALL SELECT * FROM lit_t UNION ALL SELECT * FROM blank_t",
              ("uri_t", "lit_t", "blank_t")),
    "ent_g": (_dense("SELECT s AS entity FROM graph WHERE s_kind = 'uri' "
                     "UNION ALL SELECT o AS entity FROM graph WHERE o_kind = 'uri'", "entity"), ("graph",)),
    "rel_g": (_dense("SELECT p AS relation FROM graph", "relation"), ("graph",)),
    "enc_g": ("SELECT es.id AS s, r.id AS p, eo.id AS o FROM graph g "
              "JOIN ent_g es ON es.entity = g.s JOIN ent_g eo ON eo.entity = g.o "
              "JOIN rel_g r ON r.relation = g.p WHERE g.s_kind = 'uri' AND g.o_kind = 'uri'",
              ("graph", "ent_g", "rel_g")),
    "quads": (f"SELECT '{BASE}doc/' || lang || '/' || CAST(doc_id AS VARCHAR) AS s, '{BASE}source' AS p, "
              f"'{BASE}source/' || lang || '/' || source AS o, lang AS language FROM documents", ()),
    "ent_q": (_dense("SELECT s AS entity FROM quads UNION ALL SELECT o AS entity FROM quads", "entity"), ("quads",)),
    "rel_q": (_dense("SELECT p AS relation FROM quads", "relation"), ("quads",)),
    "ent_ql": (_dense("SELECT language, s AS entity FROM quads UNION ALL SELECT language, o AS entity FROM quads",
                      "entity", "language"), ("quads",)),
    "rel_ql": (_dense("SELECT language, p AS relation FROM quads", "relation", "language"), ("quads",)),
    "rel_qs": (f"SELECT relation, id FROM rel_q UNION ALL SELECT '{OWL_SAME_AS}' AS relation, count(*) AS id FROM rel_q",
               ("rel_q",)),
    "ranked": (f"SELECT *, row_number() OVER (PARTITION BY language ORDER BY "
               f"md5(concat_ws(chr(9), '{SEED}', s, p, o)), s, p, o) - 1 AS rank, "
               f"count(*) OVER (PARTITION BY language) AS n FROM quads", ("quads",)),
    "split3": ("SELECT s, p, o, language, CASE WHEN rank < floor(0.7::DOUBLE * n) THEN 'train' "
               "WHEN rank < floor(0.85::DOUBLE * n) THEN 'valid' ELSE 'test' END AS part FROM ranked", ("ranked",)),
    "star": (f"SELECT '{BASE}source/' || lang || '/' || source AS s, '{OWL_SAME_AS}' AS p, "
             f"'{BASE}source/' || nxt || '/' || source AS o FROM (SELECT source, lang, "
             f"lead(lang) OVER (PARTITION BY source ORDER BY lang) AS nxt FROM (SELECT DISTINCT source, lang FROM documents)) "
             f"WHERE nxt IS NOT NULL", ()),
    "merged_star": (f"SELECT e.entity, coalesce(m.id, e.id) AS id FROM ent_q e LEFT JOIN ("
                    f"SELECT e2.entity, min(e2.id) OVER (PARTITION BY d.source) AS id "
                    f"FROM (SELECT DISTINCT source, lang FROM documents) d "
                    f"JOIN ent_q e2 ON e2.entity = '{BASE}source/' || d.lang || '/' || d.source) m USING (entity)",
                    ("ent_q",)),
    "split2": ("SELECT s, p, o, language, CASE WHEN rank < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS part "
               "FROM ranked", ("ranked",)),
    "merged_star_ordered": (f"SELECT e.entity, coalesce(m.id, e.id) AS id FROM ent_q e LEFT JOIN ("
                            f"SELECT e2.entity, min(e2.id) OVER (PARTITION BY d.source ORDER BY d.lang "
                            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS id "
                            f"FROM (SELECT DISTINCT source, lang FROM documents) d "
                            f"JOIN ent_q e2 ON e2.entity = '{BASE}source/' || d.lang || '/' || d.source) m USING (entity)",
                            ("ent_q",)),
    "ent_es": ("SELECT entity, id FROM ent_ql WHERE language = 'es'", ("ent_ql",)),
    "rel_es": ("SELECT relation, id FROM rel_ql WHERE language = 'es'", ("rel_ql",)),
    "quads_null": ("SELECT s, p, o, nullif(language, 'es') AS language FROM quads", ("quads",)),
    "ent_qn": (_dense("SELECT language, s AS entity FROM quads_null UNION ALL SELECT language, o AS entity "
                      "FROM quads_null", "entity", "language"), ("quads_null",)),
    "rel_qn": (_dense("SELECT language, p AS relation FROM quads_null", "relation", "language"), ("quads_null",)),
    "chain_ids": (f"SELECT o.o_orderkey, o.o_custkey, e.entity, e.id FROM orders o "
                  f"JOIN ent_g e ON e.entity = {_u('order', 'o.o_orderkey')}", ("ent_g",)),
}


def with_ctes(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body


def _tuple(cols: list[str]) -> str:
    return "'(' || concat_ws(',', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ") || ')'"


def _tsv(cols: list[str]) -> str:
    return "concat_ws(chr(9), " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _readable_node(v: str, k: str, lang: str | None = None, dt: str | None = None) -> str:
    rdf, dc = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/elements/1.1/"
    compact = (f"CASE WHEN starts_with({v}, '{rdf}') THEN 'rdf:' || substr({v}, {len(rdf) + 1}) "
               f"WHEN starts_with({v}, '{dc}') THEN 'dc:' || substr({v}, {len(dc) + 1}) ELSE {v} END")
    lit = f"'\"' || {v} || '\"'"
    if lang:
        lit = (f"CASE WHEN {lang} IS NOT NULL THEN {lit} || '@' || {lang} "
               f"WHEN {dt} IS NOT NULL THEN {lit} || '^^' || {dt} ELSE {lit} END")
    return f"CASE WHEN {k} = 'uri' THEN {compact} WHEN {k} = 'blank' THEN {v} ELSE {lit} END"


READABLE = ("SELECT " + _readable_node("s", "s_kind") + " || ' @' || " + _readable_node("p", "'uri'")
            + " || ' ' || " + _readable_node("o", "o_kind", "o_lang", "o_datatype") + " AS value FROM graph")

SPLIT_ENC = "SELECT s, p, o FROM split3 WHERE part = '{part}'"

ORACLES: dict[str, str] = {
    "s1_parse_ntriples": with_ctes("SELECT * FROM graph", "graph"),
    "s2_read_bz2_ntriples": with_ctes("SELECT * FROM graph", "graph"),
    "s3_uri_subject_lines": with_ctes("SELECT * FROM graph WHERE s_kind = 'uri'", "graph"),
    "s4_language_datasets": with_ctes("SELECT s, p, o, language, regexp_replace(o, '.*/', '') AS dataset FROM quads",
                                      "quads"),
    "s6_read_dictionary": with_ctes("SELECT entity, id FROM ent_q", "ent_q"),
    "s7_read_quads": with_ctes("SELECT * FROM quads", "quads"),
    "s8_read_links": with_ctes("SELECT * FROM star", "star"),
    "n1_node_kinds": with_ctes("SELECT s_kind, o_kind, count(*) AS n FROM graph GROUP BY s_kind, o_kind", "graph"),
    "n2_literal_parts": with_ctes("SELECT s, p, o AS lexical, o_lang, o_datatype FROM graph WHERE o_kind = 'literal'",
                                  "graph"),
    "f1_literal_object": with_ctes("SELECT * FROM graph WHERE o_kind = 'literal'", "graph"),
    "f2_uri_subject": with_ctes("SELECT * FROM graph WHERE s_kind = 'uri'", "graph"),
    "f3_literal_triples": with_ctes("SELECT * FROM graph WHERE s_kind = 'uri' AND o_kind = 'literal'", "graph"),
    "f4_uri_triples": with_ctes("SELECT * FROM graph WHERE s_kind = 'uri' AND o_kind = 'uri'", "graph"),
    "f5_blank_triples": with_ctes("SELECT DISTINCT * FROM graph WHERE s_kind = 'blank' OR o_kind = 'blank'", "graph"),
    "p1_subjects": with_ctes("SELECT s AS node, s_kind AS kind FROM graph", "graph"),
    "p1_objects": with_ctes("SELECT o AS node, o_kind AS kind FROM graph", "graph"),
    "p1_predicates": with_ctes("SELECT p AS node, 'uri' AS kind FROM graph", "graph"),
    "p2_as_spo": with_ctes("SELECT s, p, o FROM graph WHERE s_kind = 'uri' AND o_kind = 'uri'", "graph"),
    "p3_drop_language": with_ctes("SELECT s, p, o FROM quads", "quads"),
    "p4_language_rows": with_ctes("SELECT * FROM quads WHERE language IN ('es', 'fr')", "quads"),
    "d1_entities": with_ctes("SELECT DISTINCT entity FROM (SELECT s AS entity FROM graph WHERE s_kind = 'uri' "
                             "UNION ALL SELECT o FROM graph WHERE o_kind = 'uri')", "graph"),
    "d2_relations": with_ctes("SELECT DISTINCT p AS relation FROM graph", "graph"),
    "d3_dense_ids": with_ctes(_dense("SELECT s AS key FROM graph", "key"), "graph"),
    "d4_entity_dictionary": with_ctes("SELECT * FROM ent_g", "ent_g"),
    "d4_relation_dictionary": with_ctes("SELECT * FROM rel_g", "rel_g"),
    "d5_entity_dictionary_by_language": with_ctes("SELECT * FROM ent_ql", "ent_ql"),
    "d5_relation_dictionary_by_language": with_ctes("SELECT * FROM rel_ql", "rel_ql"),
    "d6_entity_dictionary_all_languages": with_ctes("SELECT * FROM ent_q", "ent_q"),
    "d7_as_lookup": with_ctes("SELECT entity, max(id) AS id FROM (SELECT entity, id FROM ent_q "
                              "UNION ALL SELECT entity, id FROM ent_ql) GROUP BY entity", "ent_q", "ent_ql"),
    "d8_sorted_by_id": with_ctes("SELECT * FROM ent_g", "ent_g"),
    "d9_append_relation": with_ctes("SELECT * FROM rel_qs", "rel_qs"),
    "j4_encode_uri": with_ctes("SELECT * FROM enc_g", "enc_g"),
    "j4_encode_uri_heavy_split": with_ctes("SELECT * FROM enc_g", "enc_g"),
    "j5_encode_literal": with_ctes("SELECT es.id AS s, r.id AS p, g.o, g.o_lang, g.o_datatype FROM graph g "
                                   "JOIN ent_g es ON es.entity = g.s JOIN rel_g r ON r.relation = g.p "
                                   "WHERE g.s_kind = 'uri' AND g.o_kind = 'literal'", "graph", "ent_g", "rel_g"),
    "j6_encode_by_language": with_ctes(
        "SELECT x.language, es.id AS s, r.id AS p, eo.id AS o FROM quads x "
        "JOIN ent_ql es ON es.language = x.language AND es.entity = x.s "
        "JOIN ent_ql eo ON eo.language = x.language AND eo.entity = x.o "
        "JOIN rel_ql r ON r.language = x.language AND r.relation = x.p", "quads", "ent_ql", "rel_ql"),
    "j7_encode_all_languages": with_ctes(_enc("quads", "ent_q", "rel_q"), "quads", "ent_q", "rel_q"),
    "j8_encode_strict": with_ctes(_enc(f"({SPLIT_ENC.format(part='train')})", "ent_q", "rel_qs"),
                                  "split3", "ent_q", "rel_qs"),
    "j8_unmapped": with_ctes(
        "SELECT x.s, x.p, x.o, es.id IS NULL AS s_missing, r.id IS NULL AS p_missing, eo.id IS NULL AS o_missing "
        "FROM quads x LEFT JOIN (SELECT entity, id FROM ent_ql WHERE language = 'en') es ON es.entity = x.s "
        "LEFT JOIN (SELECT entity, id FROM ent_ql WHERE language = 'en') eo ON eo.entity = x.o "
        "LEFT JOIN (SELECT relation, id FROM rel_ql WHERE language = 'en') r ON r.relation = x.p "
        "WHERE es.id IS NULL OR eo.id IS NULL OR r.id IS NULL", "quads", "ent_ql", "rel_ql"),
    "x1_language_counts": with_ctes("SELECT language, count(*) AS n FROM quads GROUP BY language", "quads"),
    "x2_shuffle_rank": with_ctes("SELECT s, p, o, language, rank FROM ranked", "ranked"),
    "x3_split_80_20": with_ctes("SELECT s, p, o, language, CASE WHEN rank < floor(0.8::DOUBLE * n) THEN 'train' "
                                "ELSE 'test' END AS part FROM ranked", "ranked"),
    "x4_split_70_15_15": with_ctes("SELECT * FROM split3", "split3"),
    "x5_joint_train": with_ctes("SELECT s, p, o FROM split3 WHERE part = 'train'", "split3"),
    "x6_language_part": with_ctes("SELECT s, p, o FROM split3 WHERE language = 'es' AND part = 'test'", "split3"),
    "a1_known_links": with_ctes("SELECT * FROM star WHERE s IN (SELECT entity FROM ent_q) "
                                "AND o IN (SELECT entity FROM ent_q)", "star", "ent_q"),
    "a2_links_as_triples": with_ctes(_enc("star", "ent_q", "rel_qs"), "star", "ent_q", "rel_qs"),
    "a3_train_with_links": with_ctes(_enc(f"({SPLIT_ENC.format(part='train')})", "ent_q", "rel_qs")
                                     + " UNION ALL " + _enc("star", "ent_q", "rel_qs"),
                                     "split3", "star", "ent_q", "rel_qs"),
    "a4_merge_ordered": with_ctes(
        "SELECT e.entity, coalesce(f.id, e.id) AS id FROM ent_g e LEFT JOIN (SELECT entity, min(id) OVER "
        "(PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS id "
        "FROM chain_ids) f USING (entity)", "ent_g", "chain_ids"),
    "a5_merge_components": with_ctes(
        "SELECT e.entity, coalesce(f.id, e.id) AS id FROM ent_g e LEFT JOIN (SELECT entity, min(id) OVER "
        "(PARTITION BY o_custkey) AS id FROM chain_ids) f USING (entity)", "ent_g", "chain_ids"),
    "a6_merged_dictionary": with_ctes("SELECT * FROM merged_star", "merged_star"),
    "a7_reencode_merged": with_ctes(_enc(f"({SPLIT_ENC.format(part='train')})", "merged_star", "rel_qs"),
                                    "split3", "merged_star", "rel_qs"),
    "a8_language_test_three_ways": with_ctes(
        _enc("(SELECT s, p, o FROM split3 WHERE language = 'es' AND part = 'test')", "ent_q", "rel_qs",
             "'joint' AS dictionary, ")
        + " UNION ALL " + _enc("(SELECT s, p, o FROM split3 WHERE language = 'es' AND part = 'test')",
                               "merged_star", "rel_qs", "'merged' AS dictionary, ")
        + " UNION ALL " + _enc("(SELECT s, p, o FROM split3 WHERE language = 'es' AND part = 'test')",
                               "(SELECT entity, id FROM ent_ql WHERE language = 'es')",
                               "(SELECT relation, id FROM rel_ql WHERE language = 'es')", "'own' AS dictionary, "),
        "split3", "merged_star", "rel_qs", "ent_ql", "rel_ql"),
    "k1_write_tuples": with_ctes(f"SELECT {_tuple(['s', 'p', 'o'])} AS value FROM enc_g", "enc_g"),
    "k1_read_tuples_back": with_ctes("SELECT entity, id FROM ent_g", "ent_g"),
    "k2_write_tsv": with_ctes(f"SELECT {_tsv(['s', 'p', 'o'])} AS value FROM quads", "quads"),
    "k3_write_counted": with_ctes(f"SELECT {_tsv(['entity', 'id'])} AS value FROM ent_q "
                                  "UNION ALL SELECT CAST(count(*) AS VARCHAR) AS value FROM ent_q", "ent_q"),
    "k4_write_readable": with_ctes(READABLE, "graph"),
    "k5_language_outputs": with_ctes(
        f"SELECT {_tuple(['es.id', 'r.id', 'eo.id'])} AS value, x.language, regexp_replace(x.o, '.*/', '') AS dataset "
        "FROM quads x JOIN ent_ql es ON es.language = x.language AND es.entity = x.s "
        "JOIN ent_ql eo ON eo.language = x.language AND eo.entity = x.o "
        "JOIN rel_ql r ON r.language = x.language AND r.relation = x.p", "quads", "ent_ql", "rel_ql"),
}


def _counted(rows: str) -> str:
    return f"SELECT value FROM ({rows}) UNION ALL SELECT CAST(count(*) AS VARCHAR) AS value FROM ({rows})"


def _job(outputs: dict[str, str], *ctes: str) -> str:
    """All outputs of a job: output, value."""
    return with_ctes(" UNION ALL ".join(f"SELECT '{name}' AS output, value FROM ({sql})" for name, sql in outputs.items()),
                     *ctes)


def _tsv_of(rows: str, *cols: str) -> str:
    return f"SELECT {_tsv(list(cols) or ['s', 'p', 'o'])} AS value FROM ({rows})"


def _part(table: str, part: str, language: str | None = None) -> str:
    return f"(SELECT s, p, o FROM {table} WHERE part = '{part}'" + (f" AND language = '{language}')" if language else ")")


def _two_way(merged: str) -> str:
    ent, rel = ("SELECT entity, id FROM ent_q", "entity", "id"), ("SELECT relation, id FROM rel_q", "relation", "id")
    train, test = _part("split2", "train"), _part("split2", "test")
    return _job({
        "entity2id": _counted(_tsv_of(*ent)), "relation2id": _counted(_tsv_of(*rel)),
        "URI_joint_train": _tsv_of(f"SELECT * FROM {train}"), "URI_joint_test": _tsv_of(f"SELECT * FROM {test}"),
        "triple2id_ex1": _counted(_tsv_of(_enc(train, "ent_q", "rel_q"))),
        "test2id_ex1": _tsv_of(_enc(test, "ent_q", "rel_q")),
        "modified_entity2id": _counted(_tsv_of(f"SELECT entity, id FROM {merged}", "entity", "id")),
        "triple2id_ex2": _counted(_tsv_of(_enc(train, merged, "rel_q"))),
        "test2id_ex2": _tsv_of(_enc(test, merged, "rel_q")),
    }, "split2", merged, "rel_q")


def _three_tasks(merged: str = "merged_star") -> str:
    names = ("train", "valid", "test")
    joint = {p: _part("split3", p) for p in names}
    own = {p: _part("split3", p, "es") for p in names}
    links = _enc("star", "ent_q", "rel_qs")
    outputs = {
        "entity2id": _counted(_tsv_of("SELECT entity, id FROM ent_q", "entity", "id")),
        "relation2id": _counted(_tsv_of("SELECT relation, id FROM rel_qs", "relation", "id")),
        "sameAs_URI": _tsv_of("SELECT * FROM star"),
        "modified_entity2id": _counted(_tsv_of(f"SELECT entity, id FROM {merged}", "entity", "id")),
        "triple2id_ex1": _counted(_tsv_of(_enc(joint["train"], "ent_q", "rel_qs") + " UNION ALL " + links)),
        "triple2id_ex2": _counted(_tsv_of(_enc(joint["train"], merged, "rel_qs"))),
        "es_test_original_mappings": _tsv_of(_enc(own["test"], "ent_q", "rel_qs")),
        "es_test_new_mappings": _tsv_of(_enc(own["test"], merged, "rel_qs")),
        "es_entity2id": _counted(_tsv_of("SELECT entity, id FROM ent_es", "entity", "id")),
        "es_relation2id": _counted(_tsv_of("SELECT relation, id FROM rel_es", "relation", "id")),
        "es_train": _counted(_tsv_of(_enc(own["train"], "ent_es", "rel_es"))),
    }
    for p in names:
        outputs[f"URI_joint_{p}"] = _tsv_of(f"SELECT * FROM {joint[p]}")
        outputs[f"es_{p}_URI"] = _tsv_of(f"SELECT * FROM {own[p]}")
    for p in ("valid", "test"):
        outputs[f"{p}2id_ex1"] = _tsv_of(_enc(joint[p], "ent_q", "rel_qs"))
        outputs[f"{p}2id_ex2"] = _tsv_of(_enc(joint[p], merged, "rel_qs"))
        outputs[f"es_{p}"] = _tsv_of(_enc(own[p], "ent_es", "rel_es"))
    return _job(outputs, "split3", "star", merged, "rel_qs", "ent_es", "rel_es")


_LITERAL = ("'\"' || g.o || '\"' || CASE WHEN g.o_lang IS NOT NULL THEN '@' || g.o_lang "
            "WHEN g.o_datatype IS NOT NULL THEN '^^' || g.o_datatype ELSE '' END")
_ENC_LIT = ("SELECT es.id AS s, r.id AS p, {o} FROM graph g JOIN ent_g es ON es.entity = g.s "
            "JOIN rel_g r ON r.relation = g.p WHERE g.s_kind = 'uri' AND g.o_kind = 'literal'")
_BY_LANGUAGE = (f"SELECT {_tuple(['es.id', 'r.id', 'eo.id'])} AS value, x.language, "
                "regexp_replace(x.o, '.*/', '') AS dataset "
                "FROM quads x JOIN ent_ql es ON es.language = x.language AND es.entity = x.s "
                "JOIN ent_ql eo ON eo.language = x.language AND eo.entity = x.o "
                "JOIN rel_ql r ON r.language = x.language AND r.relation = x.p")

ORACLES |= {
    "w1_encode_graph": _job({
        "entity_ids": f"SELECT {_tuple(['entity', 'id'])} AS value FROM ent_g",
        "relation_ids": f"SELECT {_tuple(['relation', 'id'])} AS value FROM rel_g",
        "uri_mappings": f"SELECT {_tuple(['s', 'p', 'o'])} AS value FROM enc_g",
        "literal_mappings": f"SELECT {_tuple(['s', 'p', 'o'])} AS value FROM ({_ENC_LIT.format(o=_LITERAL + ' AS o')})",
        "literals": READABLE + " WHERE s_kind = 'uri' AND o_kind = 'literal'",
        "blank_nodes": READABLE.replace("FROM graph", "FROM (SELECT DISTINCT * FROM graph)")
        + " WHERE s_kind = 'blank' OR o_kind = 'blank'",
        "uri_triples": READABLE + " WHERE s_kind = 'uri' AND o_kind = 'uri'",
    }, "graph", "ent_g", "rel_g", "enc_g"),
    "w2_encode_languages": with_ctes(
        f"SELECT 'entity_ids' AS output, language, CAST(NULL AS VARCHAR) AS dataset, {_tuple(['entity', 'id'])} AS value "
        f"FROM ent_ql UNION ALL SELECT 'relation_ids', language, NULL, {_tuple(['relation', 'id'])} FROM rel_ql "
        f"UNION ALL SELECT 'uri_mappings', language, dataset, value FROM ({_BY_LANGUAGE})", "quads", "ent_ql", "rel_ql"),
    "w3_encode_all_languages": _job({
        "entity_ids": f"SELECT {_tuple(['entity', 'id'])} AS value FROM ent_q",
        "relation_ids": f"SELECT {_tuple(['relation', 'id'])} AS value FROM rel_q",
        "uri_mappings": f"SELECT {_tuple(['s', 'p', 'o'])} AS value FROM ({_enc('quads', 'ent_q', 'rel_q')})",
    }, "quads", "ent_q", "rel_q"),
    "w4_two_way": _two_way("merged_star"),
    "w4_two_way_ordered": _two_way("merged_star_ordered"),
    "w5_three_tasks": _three_tasks(),
    "w5_three_tasks_ordered": _three_tasks("merged_star_ordered"),
    "s1_long_literals": f"SELECT '{BASE}doc/' || CAST(doc_id AS VARCHAR) AS s, text AS o, lang AS o_lang FROM documents",
    "s1_escapes": f"SELECT '{BASE}doc/' || CAST(doc_id AS VARCHAR) AS s, text AS o, lang AS o_lang FROM documents",
    "s1_escaped_iris": f"SELECT '{BASE}o' AS entity UNION SELECT DISTINCT '{BASE}é-' || lang || '-' || source FROM documents",
    "s1_quarantine": (
        "SELECT CASE o_orderkey % 50 "
        f"WHEN 0 THEN '<{BASE}order/' || o_orderkey || '> <{BASE}p> <{BASE}o>' "
        f"WHEN 1 THEN o_orderkey || ' <{BASE}p> <{BASE}o> .' "
        f"WHEN 2 THEN '<{BASE}order/' || o_orderkey || '> _:p <{BASE}o> .' "
        f"WHEN 3 THEN '<{BASE}order/' || o_orderkey || '> <{BASE}p> ' || o_orderkey || ' .' "
        f"ELSE '<{BASE}order/' || o_orderkey || '> <{BASE}p> \"\\q\" .' END AS line, "
        "CASE o_orderkey % 50 WHEN 0 THEN 'end' WHEN 1 THEN 'subject' WHEN 2 THEN 'predicate' WHEN 3 THEN 'object' "
        "ELSE 'escape' END AS reason FROM orders WHERE o_orderkey % 50 < 5"),
    "s1_line_counts": (
        "SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 50 > 6) AS triples, "
        "count(*) FILTER (o_orderkey % 50 < 5) AS rejected, count(*) FILTER (o_orderkey % 50 IN (5, 6)) AS skipped FROM orders"),
    "d5_dense_ids_null_scope": with_ctes("SELECT language, entity, id FROM ent_qn", "ent_qn"),
    "j6_encode_null_scope": with_ctes(
        "SELECT x.language, es.id AS s, r.id AS p, eo.id AS o FROM quads_null x "
        "JOIN ent_qn es ON es.language IS NOT DISTINCT FROM x.language AND es.entity = x.s "
        "JOIN ent_qn eo ON eo.language IS NOT DISTINCT FROM x.language AND eo.entity = x.o "
        "JOIN rel_qn r ON r.language IS NOT DISTINCT FROM x.language AND r.relation = x.p",
        "quads_null", "ent_qn", "rel_qn"),
    "x4_split_null_language": with_ctes(
        "SELECT s, p, o, language, CASE WHEN rank < floor(0.7::DOUBLE * n) THEN 'train' "
        "WHEN rank < floor(0.85::DOUBLE * n) THEN 'valid' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY language ORDER BY md5(concat_ws(chr(9), '{SEED}', s, p, o)), s, p, o) - 1 AS rank, "
        "count(*) OVER (PARTITION BY language) AS n FROM quads_null)", "quads_null"),
    "a4_merge_ordered_in_blocks": ORACLES["a4_merge_ordered"],
    "a5_merge_hub": with_ctes(
        f"SELECT entity, CASE WHEN entity = '{BASE}region/0' OR starts_with(entity, '{BASE}order/') THEN "
        f"(SELECT min(id) FROM ent_g WHERE entity = '{BASE}region/0' OR starts_with(entity, '{BASE}order/')) "
        "ELSE id END AS id FROM ent_g", "ent_g"),
    "k1_read_literals_back": with_ctes(_ENC_LIT.format(o="g.o, g.o_lang, g.o_datatype"), "graph", "ent_g", "rel_g"),
    "d3_grow_dictionary": (
        "WITH c AS (SELECT DISTINCT " + _u("customer", "o_custkey") + " AS entity, o_orderdate < TIMESTAMP '1998-01-01' AS early "
        "FROM orders), first AS (SELECT entity, row_number() OVER (ORDER BY md5(entity), entity) - 1 AS id FROM c WHERE early) "
        "SELECT * FROM first UNION ALL SELECT entity, row_number() OVER (ORDER BY md5(entity), entity) - 1 + "
        "(SELECT count(*) FROM first) AS id FROM c WHERE NOT early AND entity NOT IN (SELECT entity FROM first)"),
    "x4_split_repeated_rows": (
        "WITH l AS (SELECT CAST(l_linenumber AS VARCHAR) AS s, 'p' AS p, l_linestatus AS o, l_returnflag AS language FROM lineitem), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY md5(concat_ws(chr(9), '{SEED}', s, p, o)), s, p, o) - 1 "
        "AS rank, count(*) OVER (PARTITION BY language) AS n FROM l) "
        "SELECT s, p, o, language, CASE WHEN rank < floor(0.7::DOUBLE * n) THEN 'train' "
        "WHEN rank < floor(0.85::DOUBLE * n) THEN 'valid' ELSE 'test' END AS part FROM r"),
    "j8_encode_many": with_ctes(
        " UNION ALL ".join(
            f"SELECT '{name}' AS dictionary, q.language, es.id AS s, r.id AS p, eo.id AS o FROM quads q "
            f"JOIN {ent} es ON es.entity = q.s JOIN {rel} r ON r.relation = q.p JOIN {ent} eo ON eo.entity = q.o"
            + (" WHERE q.language = 'es'" if name == "own" else "")
            for name, ent, rel in (("given", "ent_q", "rel_qs"), ("merged", "merged_star", "rel_qs"), ("own", "ent_es", "rel_es"))),
        "quads", "ent_q", "rel_qs", "merged_star", "ent_es", "rel_es"),
}
ORACLES["a5_grow_components"] = ORACLES["a5_merge_components"]
