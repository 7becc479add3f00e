"""Edge lines of N-Triples (FIXTURES 2.1) and reader modes."""

import pytest

from helpers import lines_df
from kgprep.operators import blank_triples, entity_dictionary, literal_triples, uri_triples
from kgprep.sources import parse_ntriples, read_ntriples

EDGE = [
    "# c",
    "",
    "_:b1 <http://x/p> _:b2 .",
    "<http://x/s> <http://x/p> _:b2 .",
    '_:b1 <http://x/p> "v" .',
    '<http://x/s> <http://x/p> "a \\"q\\" <b> . # no"@en-GB . # tail',
    '<http://x/s> <http://x/p> "plain" .',
    '<http://x/s> <http://x/p> "3"^^<http://t#int> .',
    "<http://x/s> <http://x/p> <http://x/o>.",
]
BAD = "<http://x/s> bad"


def test_edge_lines_parse(spark):
    rows = parse_ntriples(lines_df(spark, EDGE)).collect()
    assert len(rows) == 7  # comment and empty line skipped
    by = {(r.s, r.o): r for r in rows}
    r = by[("http://x/s", 'a "q" <b> . # no')]
    assert (r.o_kind, r.o_lang, r.o_datatype) == ("literal", "en-GB", None)
    r = by[("http://x/s", "plain")]
    assert (r.o_kind, r.o_lang, r.o_datatype) == ("literal", None, None)
    r = by[("http://x/s", "3")]
    assert r.o_datatype == "http://t#int"
    r = by[("http://x/s", "http://x/o")]
    assert (r.s_kind, r.o_kind) == ("uri", "uri")
    assert by[("_:b1", "_:b2")].s_kind == "blank"


def test_filters_on_edge_lines(spark):
    g = parse_ntriples(lines_df(spark, EDGE))
    assert uri_triples(g).count() == 1
    assert literal_triples(g).count() == 3  # blank-subject literal excluded
    assert blank_triples(g).count() == 3
    ents = {r.entity for r in entity_dictionary(g).collect()}
    assert ents == {"http://x/s", "http://x/o"}  # blank nodes never get ids


def test_uri_subjects_only(spark):
    g = parse_ntriples(lines_df(spark, EDGE), uri_subjects_only=True)
    assert g.where("s_kind = 'blank'").count() == 0 and g.count() == 5


def test_modes(spark):
    df = lines_df(spark, EDGE + [BAD])
    assert parse_ntriples(df, mode="DROPMALFORMED").count() == 7
    perm = parse_ntriples(df, mode="PERMISSIVE").collect()
    assert [r._corrupt_record for r in perm if r._corrupt_record] == [BAD]
    with pytest.raises(Exception, match="malformed N-Triples line"):
        parse_ntriples(df).collect()


def test_duplicate_triple_is_a_bag(spark):
    g = parse_ntriples(lines_df(spark, ["<http://x/s> <http://x/p> <http://x/o> ."] * 2))
    from kgprep.operators import encode_uri, relation_dictionary
    enc = encode_uri(g, entity_dictionary(g), relation_dictionary(g)).collect()
    assert len(enc) == 2 and entity_dictionary(g).count() == 2


def test_bz2_and_blank_scope(spark, tmp):
    import bz2
    for name in ("a", "b"):
        with bz2.open(f"{tmp}/{name}.nt.bz2", "wt", encoding="utf-8") as f:
            f.write("_:x <http://x/p> <http://x/o> .\n")
    g = read_ntriples(spark, f"{tmp}/*.bz2")
    assert g.select("s").distinct().count() == 2  # same label, different files
    g2 = read_ntriples(spark, f"{tmp}/*.bz2", scope_blank_nodes=False)
    assert g2.select("s").distinct().count() == 1


def test_long_literals_parse(spark):
    long = "x" * 1_000_000
    escaped = 'a \\"q\\" \\\\ ' * 20_000
    rows = parse_ntriples(lines_df(spark, [f'<http://x/s> <http://x/p> "{t}"@en .' for t in (long, escaped)])).collect()
    assert [r.o for r in rows] == [long, 'a "q" \\ ' * 20_000]


def test_escapes_are_decoded_and_share_an_id(spark):
    lines = ["<http://x/\\u00e9> <http://x/p> <http://x/\\U0001F600> .", "<http://x/é> <http://x/p> <http://x/o> .",
             '<http://x/s> <http://x/p> "\\t\\b\\n\\r\\f\\"\\\'\\\\ \\u00E9\\uD83D\\uDE00\\\\u00e9" .']
    g = parse_ntriples(lines_df(spark, lines))
    assert {r.entity for r in entity_dictionary(g).collect()} == {"http://x/é", "http://x/\U0001F600", "http://x/o", "http://x/s"}
    assert [r.o for r in literal_triples(g).collect()] == ["\t\b\n\r\f\"'\\ é\U0001F600\\u00e9"]


@pytest.mark.parametrize("literal", ["\\q", "\\uD800 x", "\\U00110000", "\\u12"])
def test_unknown_escapes_are_malformed(spark, literal):
    line = f'<http://x/s> <http://x/p> "{literal}" .'
    assert parse_ntriples(lines_df(spark, [line]), mode="DROPMALFORMED").count() == 0
    assert parse_ntriples(lines_df(spark, [line]), mode="PERMISSIVE").collect()[0]._corrupt_record == line
    with pytest.raises(Exception, match="malformed N-Triples line"):
        parse_ntriples(lines_df(spark, [line])).collect()
