"""Parities of set members: groups that share prefix members but are too far apart are not paired."""

import random

import numpy as np
from kgprep.llm.jaccard_join import group_pairs, jaccard_components, signatures
from pyspark.sql import functions as F


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.getrandbits(40)}"
    return " ".join(words)


def test_far_copies_of_one_text_are_not_paired(spark):
    rng = random.Random(11)
    base = [f"w{rng.getrandbits(30)}" for _ in range(150)]
    texts = [edited(rng, base, 7) for _ in range(60)] + [edited(rng, base, 1) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    sets = [{tuple(t.split()[i:i + 3]) for i in range(148)} for t in texts]
    linked = {(i, j) for j in range(len(sets)) for i in range(j)
              if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert 10 < len(linked) < 200

    # common members go last, so that the prefixes of far copies share some
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    rows = signatures(docs, 3, 90, none)
    groups = rows.select(F.col("doc_id").alias("g"), "n", "prefix", F.xxhash64("cls").alias("comp"), "bits")
    met = {(r["x"], r["y"]) for r in group_pairs(groups, 90).collect()}
    assert linked <= met
    assert len(met) <= 2 * len(linked)  # most of the 2,278 pairs share enough members of their prefixes

    parent = list(range(len(sets)))
    for _ in parent:
        for i, j in linked:
            parent[i] = parent[j] = min(parent[i], parent[j])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert got == dict(enumerate(parent))
