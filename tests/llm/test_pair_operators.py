"""Hard negatives, tokenizer alignment and the n-gram Jaccard join against plain Python."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from kgprep.llm.hard_negatives import mine_hard_negatives, spanning_tree
from kgprep.llm.jaccard_join import jaccard_components
from kgprep.llm.token_alignment import Stretches, align_tokenizers, packed, unpacked
from edge_data import SCHEMA, frame, same_rows


# -- hard negatives ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, key long, rank int, v string, place long"


def vector_rows(n, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        x = (centres[i % 6] + 0.4 * rng.standard_normal(dim)).astype(np.float32)
        rows.append((i, x.tolist(), int(i % 6) if i % 11 else 3))
    some = [0.5] * dim
    rows += [(n, some, 1)] * 4 + [(100, some, 1), (700, rows[0][1], 2), (700, rows[0][1], 2), (None, some, 1), (n + 7, None, 1),
             (n + 8, some, None), (n + 9, [None] + some[1:], 1), (n + 10, [float("nan")] + some[1:], 1),
             (n + 11, [float("inf")] + some[1:], 2), (n + 12, [], 1), (n + 13, some[:2], 2), (800, [-1.0] * dim, 9),
             (n + 14, [3e38] + some[1:], 1), (n + 21, some, -4)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], VECTORS)


def brute_negatives(rows):
    kept = [(i, x, l) for i, x, l in rows if None not in (i, x, l) and all(c is not None and np.isfinite(c) for c in x)]
    dim = max(len(x) for _, x, _ in kept)
    most = int((2.0 ** 62 / dim) ** 0.5)
    made = []
    for i, x, l in kept:
        v = [max(-most, min(most, int(np.floor(256 * float(np.float32(c)))))) for c in x]
        l = int(np.fmod(l + 1, 10)) if i % 7 == 0 else l
        made.append((i, v + [0] * (dim - len(v)), l))
    out = []
    for k, (i, v, l) in enumerate(made):
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m, q) for q, (j, w, m) in enumerate(made)]
        scores.sort(key=lambda s: s[:2])
        for s, j, *_ in [s for s in scores if s[2] == l and s[3] != k][:5]:
            found = [t for t in scores if t[2] != l and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(found)]
    return out


def test_hard_negatives_equal_brute_force(spark):
    rows = vector_rows(900)
    out = mine_hard_negatives(vector_frame(spark, rows).repartition(3), share=100, block_rows=150, group_anchors=3, tile_groups=2)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows)
    assert len(expected) > 100
    same_rows(out, expected)


def test_hard_negatives_of_awkward_tables(spark):
    assert mine_hard_negatives(vector_frame(spark, []).limit(0)).count() == 0
    alone = [(100, [1.0, 2.0], 1)]
    assert mine_hard_negatives(vector_frame(spark, alone)).count() == 0
    hot = [(i, [1.0, 0.0], 1 if i % 2 else 4) for i in range(400)]  # one vector, all ties
    same_rows(mine_hard_negatives(vector_frame(spark, hot), block_rows=64, group_anchors=2), brute_negatives(hot))


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(1).integers(-50, 50, (40, 3))
    order, parent, length = spanning_tree(points)
    assert sorted(order) == list(range(40)) and (parent < 0).sum() == 1
    place = np.argsort(order)
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    for i in range(40):
        if parent[i] >= 0:
            assert place[parent[i]] < place[i] and distance[i, parent[i]] <= length[i] <= distance[i, parent[i]] + 1e-3
    edges, root, total = sorted((distance[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert abs(total - length.sum()) < 1e-3


# -- alignment ---------------------------------------------------------------------------------

ODD = [" ", "  ", "a  b", " a", "a ", "a \n b", "x\n\n y\t z ", "<|endoftext|> <s> </s> <unk> ▁ x", "▁", "no ▁ here", "fine",
       "it's we'll 'tis  '", "naïve Übung ﬁ ① Å é \U0001F600 日本語 テスト", "\x00\x1c \x1d x\x85 y\xa0z　w", "a" * 700, "ab " * 900,
       "1234567890 12 345", "!!! ??? ...\r\n", "\n", "tab\tsep tab \tsep", "end\n ", "<0x41> <0xZZ>", "a​ b   c"]


@pytest.fixture(scope="module")
def tools():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    words = {i: w for w, i in ranks.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), words, b.encode, pieces


def plain_alignment(text, tools):
    """(n_a, n_b, groups text, Counter of links) by a walk over bytes."""
    encode_a, words, encode_b, pieces = tools
    none = (0, 0, [], Counter())
    if not text:
        return none
    a, b = encode_a(text), encode_b(text)
    raw = (" " + text).encode()
    if b"".join(words[i] for i in a) != raw or b"".join(pieces[i] for i in b) != raw:
        return none
    owner_a = [k for k, i in enumerate(a) for _ in words[i]]
    owner_b = [k for k, i in enumerate(b) for _ in pieces[i]]
    links = Counter((a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b))))
    groups, first = [], 0
    for at in range(1, len(raw) + 1):
        if at == len(raw) or owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]:
            x, y = sorted(set(owner_a[first:at])), sorted(set(owner_b[first:at]))
            groups.append(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[i]) for i in y))
            first = at
    return len(a), len(b), groups, links


@pytest.mark.parametrize("head_pairs", [1 << 21, 50])
def test_alignment_equals_a_walk_over_bytes(spark, rows, tools, head_pairs):
    rows = [r for r in rows if r[0] != 17] + [(5000 + i, t) for i, t in enumerate(ODD)]
    plain = [(i, plain_alignment(t, tools)) for i, t in rows]
    held = Counter(p for _, x in plain for p in x[3])
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    expected = []
    for i, (n_a, n_b, groups, links) in plain:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        expected.append((i, n_a, n_b, len(groups), sum(links.values()), digest,
                         sum(k for p, k in links.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in links.items())))
    docs = frame(spark, rows).repartition(3)
    same_rows(align_tokenizers(docs.select("doc_id", "text"), digest=True, head_pairs=head_pairs), expected)
    if head_pairs > 50:
        out = align_tokenizers(docs)
        assert out.columns == [c for c in docs.columns if c != "text"] + [
            "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        assert sorted((r["doc_id"] or 0, r["groups"]) for r in out.collect()) == sorted(
            (i or 0, ";".join(x[2])) for i, x in plain)


def test_alignment_of_an_empty_table(spark, empty):
    assert align_tokenizers(empty, digest=True).count() == 0
    one = align_tokenizers(spark.createDataFrame([(None, None)], "doc_id long, text string"), digest=True).collect()
    assert [tuple(r) for r in one] == [(None, 0, 0, 0, 0, "", 0, 0)]


def test_stretches_give_the_ids_of_whole_texts(rows, tools):
    known = Stretches()
    rng = random.Random(2)
    signs = ["a", "Bc", " ", "  ", "\n", "\t", "é", ".", "12", "'s", "\x1c", " ", "日", "x" * 70]
    texts = [t for _, t in rows if t][:60] + ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        numbers = known.of(t)
        a = [i for k in numbers for i in known.a_ids[known.a_at[k]:known.a_at[k + 1]]]
        b = [i for k in numbers for i in known.b_ids[known.b_at[k]:known.b_at[k + 1]]]
        assert a == tools[0](t), repr(t)
        if all(known.whole[k] for k in numbers):
            assert b == tools[2](t), repr(t)


def test_packed_links_come_back():
    pairs, times = np.array([0, 5, 1 << 31, (1 << 32) - 1]), np.array([1, 255, 256, 700])
    back = Counter()
    for p, n in zip(*unpacked(packed(pairs, times))):
        back[int(p)] += int(n)
    assert back == dict(zip(pairs.tolist(), times.tolist()))
    assert len(unpacked(packed(np.zeros(0, np.int64), np.zeros(0, np.int64)))[0]) == 0


# -- Jaccard join ------------------------------------------------------------------------------

def brute_components(rows, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append(frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and find(x) != find(y) and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def near_copies(n=60, seed=4):
    """Copies of a few texts with words changed, dropped or added: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(words) for _ in range([25, 40, 80, 120, 150, 300][base])]
        for k in range(n):
            new = list(text)
            for _ in range(rng.randint(0, 3)):
                at, what = rng.randrange(len(new)), rng.randint(0, 2)
                new[at:at + (what != 2)] = [] if what == 0 else [rng.choice(words)]
            rows.append((10_000 + 1000 * base + k, " ".join(new)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("common", [64, 3])
def test_jaccard_components_equal_brute_force(spark, rows, common):
    data = rows + near_copies() + [(None, near_copies()[0][1])]
    expected = brute_components(data)
    sizes = Counter(c for _, _, c in expected)
    assert sum(n > 1 for n in sizes.values()) > 5 and sum(n == 1 for n in sizes.values()) > 50
    out = jaccard_components(frame(spark, data).repartition(4), common=common)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    same_rows(out, expected)


def test_jaccard_components_without_stars(spark, monkeypatch):
    """The exact join alone finds every link: stars only spare work."""
    from kgprep.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "star_pairs", lambda classes: jaccard_join.written(
        classes.select(classes.cls.alias("a"), classes.cls.alias("b")).limit(0), "none"))
    data = near_copies(25, seed=9)
    same_rows(jaccard_components(frame(spark, data)), brute_components(data))
    same_rows(jaccard_components(frame(spark, data), percent=70), brute_components(data, 70))


def test_jaccard_components_of_awkward_tables(spark, empty):
    assert jaccard_components(empty).count() == 0
    data = [(None, "a b c d"), (None, "A  B c\td"), (7, None), (7, ""), (8, " \n"), (None, None), (3, "a"), (2, "A"), (5, "a b")]
    same_rows(jaccard_components(frame(spark, data)), brute_components(data))
    assert SCHEMA  # extra columns with clashing names are in every frame above
