"""Near copies of a text that is not among them: the links of a large cluster are not listed pair by pair."""

import random

from kgprep.llm import jaccard_join


def test_near_copies_without_their_base_are_not_paired_with_each_other(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.getrandbits(30)}" for _ in range(150)]
    texts = []
    for k in range(240):
        words = list(base)
        for _ in range(1 + k % 2):
            words[rng.randrange(len(words))] = f"e{rng.getrandbits(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(148)} for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j)
             if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    parent = list(range(len(sets)))
    for _ in range(8):
        for i, j in links:
            parent[i] = parent[j] = min(parent[i], parent[j])

    rows, plain = {}, jaccard_join.written

    def counted(df, name, *more):
        out = plain(df, name, *more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict(enumerate(parent))
    assert len(links) > 6000
    assert rows["opened"] < len(links) // 5  # 5,517 of 8,227 when each class met one other of its star
    assert rows.get("lead-pairs", 0) < 20 * len(texts)
