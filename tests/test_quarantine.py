"""Malformed lines go to a side table with their place and reason; counts add up to the input."""

import random

import pytest

from kgprep.sources import FAILFAST, read_ntriples, read_with_quarantine

GOOD = '<http://x/s> <http://x/p> "v"@en .'
BAD = {
    "s <http://x/p> <http://x/o> .": "subject", '"s" <http://x/p> <http://x/o> .': "subject", "junk": "subject",
    "<http://x/s> _:p <http://x/o> .": "predicate", "<http://x/s> bad": "predicate",
    "<http://x/s> <http://x/p> o .": "object", '<http://x/s> <http://x/p> "open .': "object",
    "<http://x/s> <http://x/p> .": "object", "<http://x/s> <http://x/p> <http://x/o>": "end",
    '<http://x/s> <http://x/p> "v" . tail': "end", '<http://x/s> <http://x/p> "\\q" .': "escape",
    "<http://x/\\u12> <http://x/p> <http://x/o> .": "escape",
}
SKIPPED = ["", "   ", "# comment", " # comment"]


@pytest.fixture()
def files(tmp_path):
    rng = random.Random(3)
    lines = {}
    for name, size in (("a.nt", 3000), ("b.nt", 400), ("c.nt", 1)):
        lines[name] = rng.choices([GOOD, *BAD, *SKIPPED], [8, *[1] * len(BAD), *[1] * len(SKIPPED)], k=size)
        (tmp_path / name).write_text("\n".join(lines[name]) + "\n")
    lines["d.nt"] = []
    (tmp_path / "d.nt").write_text("")
    return str(tmp_path), lines


@pytest.mark.parametrize("split_bytes", [2000, 1 << 27])
def test_rows_reasons_and_counts(spark, files, split_bytes):
    root, lines = files
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        out = read_with_quarantine(spark, f"{root}/*.nt")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["line"], r["reason"]) for r in out.rejected.collect())
    want = sorted((f, i + 1, x, BAD[x]) for f, xs in lines.items() for i, x in enumerate(xs) if x in BAD)
    assert got == want
    counts = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in out.counts.collect()}
    assert counts == {f: (len(xs), xs.count(GOOD), sum(x in BAD for x in xs), sum(x in SKIPPED for x in xs))
                      for f, xs in lines.items() if xs}
    assert out.triples.count() == sum(xs.count(GOOD) for xs in lines.values())


def test_triples_are_those_of_a_plain_scan(spark, tmp):
    with open(f"{tmp}/g.nt", "w") as f:
        f.write("\n".join([GOOD, "# c", "_:b <http://x/p> _:c .", "", "<http://x/s> <http://x/p> <http://x/\\u00e9> ."]))
    out = read_with_quarantine(spark, f"{tmp}/g.nt")
    plain = read_ntriples(spark, f"{tmp}/g.nt", mode=FAILFAST)
    assert out.triples.schema == plain.schema
    assert sorted(map(repr, out.triples.collect())) == sorted(map(repr, plain.collect()))
    assert out.rejected.isEmpty()
