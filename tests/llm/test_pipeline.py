"""The corpus pipeline: every stage against plain Python on its own input."""

import hashlib
import os
import sys

import pyarrow.parquet as pq
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from edge_data import SF  # noqa: E402
from kgprep.llm.common import table, written  # noqa: E402
from kgprep.llm.packing import encoder  # noqa: E402
from kgprep.llm.toxicity import toxicity_digest  # noqa: E402
from test_free_operators import fingerprint, groups  # noqa: E402
from test_native_operators import contamination_rows, line_rows  # noqa: E402


def expected(name, spark, docs, rows):
    """Ids that stay, for a stage that drops documents."""
    if name == "toxicity":
        scored = toxicity_digest(docs, table(spark, SF, "labels")).collect()
        return [r["doc_id"] for r in scored if not r["predicted"]]
    if name == "simhash_near_dedup":
        fps = {i: fingerprint(t) for i, t in rows}
        root, least = groups(set(fps.values())), {}
        for i, f in sorted(fps.items()):
            least.setdefault(root[f], i)
        return list(least.values())
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = [(str(i), t) for i, t in zip(items["item_id"], items["text"])]
    return [r[0] for r in contamination_rows(rows, items) if not r[5]]


def test_every_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = written(stage(spark, docs, SF), name)
        if name == "best_fit_packing":
            encode = encoder()
            assert sum(r["length"] for r in out.collect()) == sum(len(encode(t)) + 1 for _, t in rows)
            break
        assert out.columns == columns
        got = out.collect()
        if name == "line_dedup":
            want = {i: h for i, _, _, h in line_rows(rows)}
            assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in got} == want
        else:
            assert sorted(r["doc_id"] for r in got) == sorted(expected(name, spark, docs, rows))
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        docs = out


def test_edge_rows_and_an_empty_table_go_through(spark, docs, empty):
    for given in (docs, empty):
        current = given
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, current, SF), name)
            if name != "best_fit_packing":
                assert out.columns == given.columns
            current = out
        assert (current.count() > 0) == (given is docs)


def test_callers_columns_keep_their_values(spark, docs):
    """Names that the operators add or use inside, with values that no operator gives."""
    names = ["score", "predicted", "held_out", "votes", "hits", "n_words", "n_hit", "n_items", "item_ids", "contaminated",
             "n_lines", "n_dropped", "kept_text", "t1", "fp", "label", "_row", "_r", "_k", "row", "component_id"]
    given = docs.select("doc_id", "text", "n_chars", *[F.lit(-5).alias(n) for n in names])
    ids = {r["doc_id"] for r in given.collect()}
    for current in (given, docs.select("doc_id", "text")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, current, SF), name)
            assert out.columns == current.columns
            rows = out.collect()
            assert rows and {r["doc_id"] for r in rows} <= ids
            assert all(r[n] == -5 for r in rows for n in names if n in out.columns)
            current = out
