"""Sharding, line dedup, decontamination and secret scans against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from kgprep.llm.decontamination import contamination_digest, decontaminate, proximity_matches
from kgprep.llm.line_dedup import dedup_lines, line_dedup_digest, repeated_lines
from kgprep.llm.secrets import battery, secrets_digest
from kgprep.llm.sharding import assign_shards, jump_shard, shard_documents, unsigned_key
from edge_data import same_rows


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    ids = spark.range(300).select("id", unsigned_key(F.xxhash64("id")).alias("k"))
    for n in (1, 2, 24, 25, 1000):
        for r in ids.select("id", jump_shard(F.col("k"), n).alias("s")).collect():
            assert r["s"] == jump(xxhash.xxh64_intdigest(struct.pack("<q", r["id"]), 42), n)


def test_shards(docs, rows, empty):
    out = shard_documents(docs).collect()
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in out)
    assert got == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key") for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in out:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    assert shard_documents(empty).count() == 0


def test_appending_a_shard_moves_the_necessary_share(spark):
    moved = assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), 9).where("shard <> grown_shard")
    assert 0.08 < moved.count() / 20_000 < 0.12


def line_rows(rows):
    lines = [[(line, lower(line.strip(" \t\n\x0b\f\r"))) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (i, _), parts in zip(rows, lines):
        for _, key in parts:
            if len(key) >= 10:
                holders[key].add((i is None, i))
    out = []
    for (i, _), parts in zip(rows, lines):
        kept = [line for line, key in parts
                if len(holders.get(key, ())) < 2 or min(holders[key], key=lambda h: (h[0], h[1] or 0)) == (i is None, i)]
        out.append((i, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(docs, rows, empty):
    same_rows(line_dedup_digest(docs), line_rows(rows))
    assert line_dedup_digest(empty).count() == 0
    whole = dedup_lines(docs)
    assert whole.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert whole.where("source = 'src' AND score = 0.5").count() == len(rows)


def test_heavy_lines_take_the_other_join(spark):
    rows = [(i, "a line in every document\nown line number %d" % (i // 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same_rows(line_dedup_digest(docs), line_rows(rows))
    lines = spark.createDataFrame([(1, 2, i) for i in range(50)] + [(3, 4, 1), (3, 4, 2)], "h1 long, h2 long, doc_id long")
    flags = {r["h1"]: r["heavy"] for r in repeated_lines(lines, heavy_share=0.5).collect()}
    assert flags == {1: True, 3: False}


ITEMS = [("a", "Alpha0 gamma1"), ("b", None), ("c", ""), ("d", "one"), (None, "first of two"), ("e", "one two")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination_rows(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[s:s + 13])].add(item or "")
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                ids = windows.get(tuple(w[s:s + n]))
                if ids:
                    hit.update(range(s, s + n))
                    found |= ids
        ids = sorted(found, key=lambda x: x.encode())
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, docs, rows, empty):
    passage = rows[0][1]
    items = ITEMS + [("long", " ".join(passage.split()[10:40])), ("same", " ".join(passage.split()[10:40])),
                     ("given", " ".join(rows[60][1].split()[:25])), ("absent", "zzz " * 20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    same_rows(contamination_digest(docs, bench), contamination_rows(rows, items))
    assert contamination_digest(empty, bench).count() == 0
    none = contamination_digest(docs, spark.createDataFrame([], bench.schema)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] or r["n_hit"] for r in none)
    out = decontaminate(docs, bench)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + [
        "n_words", "n_hit", "n_items", "item_ids", "contaminated"]


def test_items_of_a_shared_template_are_gathered_once(spark, monkeypatch):
    from kgprep.llm import decontamination

    template = [f"t{i}" for i in range(40)]
    items = [(f"i{k}", " ".join([*template, f"own{k}"])) for k in range(60)] + [("other", " ".join(template[:20]))]
    rows = [(1, " ".join(template * 5)), (2, " ".join([*template, "own7"])), (3, "nothing"), (None, " ".join(template))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    plans, store = [], decontamination.written

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(decontamination, "written", recorded)
    out = contamination_digest(docs, bench)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    # no id array of a phrase, and none beside each occurrence
    gathered = [line for plan in plans for line in plan.splitlines() if re.search(r"collect_(set|list)\(", line)]
    assert gathered and not any("collect_set(item_id" in g or re.search(r"collect_list\([^)]*item_ids", g) for g in gathered)
    same_rows(out, contamination_rows(rows, items))


def test_proximity_allows_inserted_words(spark):
    docs = spark.createDataFrame([(1, "red green blue white black"), (2, "red so green and blue so white and black"),
                                  (3, "black white blue green red")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "red green blue white black")], "item_id string, text string")
    found = {s: {r["doc_id"] for r in proximity_matches(docs, items, probes=5, slack=s).collect()} for s in (0, 4)}
    assert found == {0: {1}, 4: {1, 2}}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, f"{k}:{a}:{b}") for a, _, k, b in sorted(spans)]


def test_secret_base_spans(docs, rows, empty):
    expected = []
    for i, t in rows:
        spans = base_spans(t or "")
        n = Counter(k for k, _ in spans)
        expected.append((i, n["assign"], n["access"], n["hex"], sha(",".join(s for _, s in spans))))
    out = secrets_digest(docs)
    same_rows(out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), expected)
    for r in out.collect():
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert sha(",".join(kept)) == r["base_sha256"]
    assert secrets_digest(empty).count() == 0


def test_battery_tells_random_from_regular(spark):
    tokens = ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "0123456789abcdef0123456789abcdef01234567",
              "aaaaaaaabbbbbbbb11111111", "U3x9KqPz7LmW2vRtY8sN4dHc"]
    got = {r["match"]: r["looks_random"] for r in battery(spark.createDataFrame([(t,) for t in tokens], "match string"))
           .collect()}
    assert got == dict(zip(tokens, (True, False, False, True)))


@pytest.mark.parametrize("token", ["k9Xv2LqPz7RmWt4sN8dHc1bGfYj3uA5e"])
def test_unlabelled_key_is_found_and_words_are_not(spark, token):
    plain = "the quick brown fox jumps over heitlichschchkeittzein and internationalization "
    docs = spark.createDataFrame([(1, plain * 40 + token), (2, plain * 40)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets_digest(docs).collect()}
    start = len(plain) * 40
    assert spans == {1: f"random:{start}:{start + len(token)}", 2: ""}
