"""Fingerprints, near-dedup, substring dedup, LM scoring, toxicity and packing against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgprep.llm.components import component_minimum
from kgprep.llm.fingerprints import block_tables, distance, fingerprint_digest, fingerprint_documents, within_radius
from kgprep.llm.packing import best_fit_decreasing, bin_bound, encoder, pack_documents, pack_lengths, sequences
from kgprep.llm.scoring import model_code, packed_counts, score_texts
from kgprep.llm.simhash_dedup import allocate, first_of_each_group, links, near_duplicate_digest
from kgprep.llm.substring_dedup import remove_repeats, repeats_digest
from kgprep.llm.suffix_arrays import permuted_common_prefixes, suffix_array
from kgprep.llm.toxicity import fit_linear, induced_lexicon, label_model, score_documents, toxicity_digest
from edge_data import same_rows


def raw(text):
    return (text or "").encode("utf-8", "surrogatepass")


# -- fingerprints ------------------------------------------------------------------------------

def test_edited_texts_and_likeness(docs, rows, empty):
    out = fingerprint_digest(docs).collect()
    h = {t: xxhash.xxh64_intdigest(raw(t), 42) for _, t in rows if t is not None}
    h = {t: v - (1 << 64) if v >> 63 else v for t, v in h.items()} | {None: 42}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    expected = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        expected.append((i, len(t), hashlib.sha256(raw(edited)).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=repr) == sorted(expected, key=repr)
    prints = {}
    for r in out:
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert len(r["fingerprint"]) == 32
    for r in fingerprint_documents(docs).collect():
        texts = [t for i, t in rows if i == r["doc_id"]]
        if len(texts) == 1:
            assert prints.setdefault(texts[0] or "", r["fp"]) == r["fp"]
    long = [r for r in out if r["n_chars"] > 600 and (r["doc_id"] or 0) >= 1000]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)
    values = {i: f for i, f in ((r["doc_id"], r["fingerprint"]) for r in out)}
    every = [int(r["fingerprint"], 16) for r in out]
    for r in out:
        near = sum((int(values[r["doc_id"]], 16) ^ f).bit_count() <= 3 for f in every) - 1
        assert r["n_near"] == (near if r["doc_id"] is not None and r["doc_id"] % 100 == 0 else None)
    assert fingerprint_digest(empty).count() == 0


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 6), (5, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [b ^ sum({1 << rng.randrange(128) for _ in range(rng.randint(0, radius + 2))}) for b in base for _ in range(5)]
    fps = sorted({f"{v:032x}" for v in base + near})
    frame = spark.createDataFrame([(f,) for f in fps], "fp string")
    queries = frame.where(F.substring("fp", 1, 1) < "8")
    got = {(r["q"], r["fp"]): r["bits"] for r in within_radius(frame, queries, radius, blocks).collect()}
    want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in fps if a < "8" for b in fps}
    assert got == {k: v for k, v in want.items() if v <= radius}
    assert len(block_tables(radius, blocks)) == math.comb(blocks, radius)


def test_distance(spark):
    rows = spark.createDataFrame([("f" * 32, "0" * 32), ("8" + "0" * 31, "0" * 32)], "a string, b string")
    assert [r[0] for r in rows.select(distance("a", "b")).collect()] == [128, 1]


# -- SimHash near-dedup ------------------------------------------------------------------------

def fingerprint(text):
    w = [b.lower() for b in re.split(rb"[\x20\x09-\x0D]+", raw(text)) if b]
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in hashes) > len(hashes))


def groups(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(list(values), np.uint64)
    for i, v in enumerate(array):
        for j in np.nonzero(np.bitwise_count(array[i + 1:] ^ v) <= 2)[0]:
            parent[root(int(array[i + 1 + j]))] = root(int(v))
    return {v: root(v) for v in values}


def test_near_duplicates(docs, rows, empty):
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = groups({f for _, f in fps})
    least = defaultdict(list)
    for i, f in fps:
        least[root[f]] += [i] if i is not None else []
    same_rows(near_duplicate_digest(docs), [(i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in fps])
    assert near_duplicate_digest(empty).count() == 0
    kept = first_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({root[f] for _, f in fps})
    assert sorted(i for i in ids if i is not None) == sorted(min(v) for v in least.values() if v)


def test_crowded_buckets_have_the_same_components(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = groups(values)
    sizes = sorted(Counter(want.values()).values())
    for limit in (4, 1000):
        labels = component_minimum(links(fps, pair_limit=limit))
        found = Counter(r["label"] for r in labels.collect())
        lone = len(values) - sum(found.values())
        assert sorted([*found.values(), *[1] * lone]) == sizes


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    labels = {r["node"]: r["label"] for r in component_minimum(edges).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and labels[2000] == labels[2001] != labels[0]
    assert component_minimum(edges.limit(0)).count() == 0


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 20.0}]
    assert allocate(costs, 1) == (10.0, [1, 0])


# -- suffix arrays -----------------------------------------------------------------------------

def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(3)
    strings = [[1] * 50, [1, 2] * 40, list(range(1, 30)), list(range(30, 0, -1)), [1], []]
    strings += [[rng.randint(1, rng.choice([1, 2, 4, 30])) for _ in range(rng.randint(1, 80))] * rng.choice([1, 3])
                for _ in range(150)]
    for s in strings:
        s = [*s, 0]
        order = suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        _, plcp = permuted_common_prefixes(np.array(s), order, 4)
        for a, b in zip(order, order[1:]):
            n = 0
            while s[a + n] == s[b + n]:
                n += 1
            assert plcp[b] == n


def removed(rows, length):
    counts = Counter(raw(t)[i:i + length] for _, t in rows for i in range(len(raw(t)) - length + 1))
    out = []
    for i, t in rows:
        b, mark = raw(t), bytearray(len(raw(t)))
        for p in range(len(b) - length + 1):
            if counts[b[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), sum(1 for s in bytes(mark).split(b"\0") if s),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(docs, rows, empty):
    rows = [r for r in rows if r[0] != 17]
    docs = docs.where("doc_id IS NULL OR doc_id <> 17")
    same_rows(repeats_digest(docs), removed(rows, 400))
    assert repeats_digest(empty).count() == 0
    assert remove_repeats(docs).columns == [c for c in docs.columns if c != "kept"] + [
        "n_bytes", "n_removed", "n_spans", "kept"]


def test_crowded_anchor_is_counted_by_window(spark, monkeypatch):
    from kgprep.llm import substring_dedup as S

    rng = random.Random(9)
    word = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    shared = " ".join(word[:130])
    rows = [(i, " ".join(rng.sample(word, 60)) + " " + shared[:500 + i * 3] + " " + " ".join(rng.sample(word, 60)))
            for i in range(40)] + [(99, "é" * 300 + shared[50:480])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows, 400)
    same_rows(repeats_digest(docs), want)
    spans = S.repeated_spans
    monkeypatch.setattr(S, "repeated_spans", lambda d, n: spans(d, n, shard_bytes=1))
    same_rows(repeats_digest(docs), want)


# -- LM scoring --------------------------------------------------------------------------------

def test_base_scores_and_held_out_gain(docs, rows, empty):
    tokens = [[*raw(t).lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, h, len(ws), sum(w in counts for w in ws), total,
                    round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 5))
                   for (i, _), h, ws in zip(rows, held, tokens)), key=repr)
    out = score_texts(docs).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 5)) for r in out), key=repr)
    assert got == want
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in out)
    assert score_texts(empty).count() == 0


def test_packed_counts_round_trip():
    pack, unpack = packed_counts()
    for ids, times in (([0], [1]), ([3, 70000, 400000], [256, 1, 100000]), ([65535, 131070], [255, 510]), ([0, 1], [511, 2])):
        found = Counter()
        for i, n in zip(*unpack(*pack(np.array(ids), np.array(times)))):
            found[int(i)] += int(n)
        assert +found == Counter(dict(zip(ids, times)))


def test_word_probabilities_sum_to_at_most_one():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {b"\n", b"x" * 90})
    counts = np.array([rng.choice([0, 1, 2, 50]) for _ in words])
    table_sums, train, score = model_code()
    seen = [w for w, c in zip(words, counts) if c]
    tables = table_sums(seen, counts[counts > 0])
    weights, _, apm = train(seen, counts[counts > 0], tables)
    p = 10 ** score(words, counts, tables, weights, apm)
    assert 0.3 < p.sum() <= 1 + 1e-9
    assert np.corrcoef(np.log(p[counts > 0]), np.log(counts[counts > 0]))[0, 1] > 0.7


# -- toxicity ----------------------------------------------------------------------------------

def toxic_rows(n=600):
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioubdglmnrst") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    bad = ["grunkel", "zmorfid", "idiot", "plovenst"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = rng.random() < 0.25
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(60), w + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    out = [r for r in toxicity_digest(docs, known).collect()]
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)
    tested = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) > 0.95 * len(tested)


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in labels]
    a, b = (sorted(toxicity_digest(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
            for x in (labels, flipped))
    assert a == b


def test_toxicity_edge_cases(spark, docs, rows, empty):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (4, None, None)], schema)
    out = score_documents(docs, labels)
    assert out.count() == len(rows)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["held_out", "score", "predicted"]
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity_digest(docs, spark.createDataFrame([], schema)).count() == len(rows)
    assert toxicity_digest(empty, labels).count() == 0


def test_every_sure_entry_is_in_the_lexicon(spark):
    rng = random.Random(12)
    bad = [f"{i:03d}" for i in range(900)]
    deal = [w for _ in range(6) for w in rng.sample(bad, 900)]
    rows = [(" ".join(["ok", *deal[18 * i:18 * i + 18]]), 1) for i in range(300)] + [("ok fine", 0)] * 3000
    found = induced_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {w.decode() for kind, w in found if kind == 0} == set(bad)


def test_sparse_fit_meets_the_optimum():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 30)) < 0.2).astype(float)
    t = (x[:, 0] + x[:, 1] > 0).astype(float)
    w = fit_linear([(np.nonzero(v)[0].tolist(), y, 0.5) for v, y in zip(x, t)], 30)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    gradient = np.append(x.T @ (0.5 * (p - t)) + 0.5 * w[:-1], (0.5 * (p - t)).sum() + 1e-3 * w[-1])
    assert np.abs(gradient).max() < 1e-4


def test_label_model_discounts_correlated_voters():
    rng = random.Random(2)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        echo = rng.random() < (0.6 if y else 0.2)  # voters 0 to 2 always agree, and are weak
        votes = 0b111 * echo
        for j in (3, 4, 5, 6):
            votes |= (rng.random() < (0.8 if y else 0.05)) << j
        seen[(votes, int(y) if rng.random() < 0.1 else None)] += 1
    posterior = label_model([(v, y, n) for (v, y), n in seen.items()])
    assert posterior[0b111] < 0.3 and posterior[0b1111000] > 0.9


# -- packing -----------------------------------------------------------------------------------

def test_packing(docs, rows, empty):
    encode = encoder()
    out = pack_documents(docs, keep_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = np.append(encode(t or ""), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(held) <= math.ceil(sum(r["length"] for r in out) / 2048) + 1
    assert pack_documents(empty).count() == 0


def test_encoder_is_the_tokenizers_one(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    odd = ["  x \r\n\r\n  y", "á‍\U0001F469", "don't WE'LL 3.14", " ", "\t\t x", "日本語 текст"]
    for text in [t for _, t in rows[:60] if t] + odd:
        assert fast(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(100)], "doc_id long, text string")
    packed = pack_documents(docs, capacity=64, keep_ids=True).cache()
    total = packed.agg(F.sum("length")).first()[0]
    rows = sequences(packed).collect()
    assert sum(len(r["ids"]) // 4 for r in rows) == total and max(len(r["ids"]) for r in rows) <= 256


def test_bounds_and_exchange(spark):
    rng = random.Random(6)
    for _ in range(40):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        _, _, bins = best_fit_decreasing(lengths, 100)
        bound = bin_bound(np.bincount(lengths, minlength=101), 100)
        assert math.ceil(sum(lengths) / 100) <= bound <= bins
    assert bin_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert bin_bound(np.bincount([34] * 9, minlength=101), 100) == 5
    lengths = [rng.randint(1, 2047) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "rid long, length long")
    together = best_fit_decreasing(lengths, 2048)[2]
    used = {}
    for rounds in (1, 6):
        placed = pack_lengths(rows, partition_pieces=100, rounds=rounds)
        used[rounds] = placed.select("turn", "part", "bin").distinct().count()
        assert placed.count() == placed.select("rid").distinct().count() == 3000
    assert together <= used[6] < used[1] and used[6] <= 1.04 * together


# -- large ids ---------------------------------------------------------------------------------

def test_large_ids_beside_a_null_id_stay_exact(spark):
    rng = random.Random(9)
    ids = [(1 << 53) + 1, (1 << 60) + 1, (1 << 62) + 3, -(1 << 61) - 1, None]
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), i) for i in ids]
    rows += [(i + 2, t, i) for i, t, _ in rows if i is not None]  # a copy with a larger id
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long").coalesce(1)
    want = Counter(i for i, _, _ in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (near_duplicate_digest(docs), toxicity_digest(docs, labels), pack_documents(docs), fingerprint_documents(docs)):
        assert Counter(r["doc_id"] for r in out.collect()) == want
    assert Counter((r["doc_id"], r["other"]) for r in score_documents(docs, labels).collect()) == Counter(
        (i, o) for i, _, o in rows)
    same_rows(first_of_each_group(docs).select("doc_id"), [(i,) for i in ids])


def test_large_ids_beside_null_ids_have_their_own_neighbours(spark):
    rng = random.Random(4)
    rows = [((1 << 60) + 7 * k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for k in range(60)]
    rows += [(None, "first without an id"), (None, "second without an id"), ((1 << 63) - 1, "largest"), (-(1 << 63), "smallest")]
    hashes = {t: xxhash.xxh64_intdigest(raw(t), 42) for _, t in rows}
    hashes = {t: v - (1 << 64) if v >> 63 else v for t, v in hashes.items()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    expected = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        expected.append((i, len(t), hashlib.sha256(raw(t[:len(t) - half] + after[:half])).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same_rows(fingerprint_digest(docs).select("doc_id", "n_chars", "edited_sha256"), expected)
