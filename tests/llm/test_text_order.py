"""LM scoring codes a text in its order: contexts across words against plain Python."""

import random
import zlib

import numpy as np
from kgprep.llm.scoring import (SLOTS, block_junctions, block_table, block_words, context_tables, junction_keys,
                                model_code, packed_numbers, score_texts, word_codes)
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def plain_tables(texts):
    """Counts of every slot from the bits of whole texts, one after the other."""
    tables = [{} for _ in SLOTS]
    for text in texts:
        data = b"    " + b"".join(w + b" " for w in text.encode().lower().split()) + b"\n"
        for at in range(4, len(data)):
            for j in range(8):
                partial, bit = (1 << j) | (data[at] >> (8 - j)), (data[at] >> (7 - j)) & 1
                h = 0
                for k, size in enumerate(SLOTS):
                    h = (h + data[at - k - 1] + 1) * 0x9E3779B97F4A7C15 & MASK
                    h ^= h >> 29
                    x = (h ^ (partial * 0xD6E8FEB86659FD93 & MASK)) * 0xBF58476D1CE4E5B9 & MASK
                    tables[k].setdefault((x >> 32) % size, [0, 0])[bit] += 1
    return tables


def test_tables_hold_the_contexts_of_running_text(spark):
    rng = random.Random(3)
    words = ["a", "I", "of", "the", "then", "é", "日本", "word", "x" * 40, "b", "\0", "a\0b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "a", "a b"]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    blocks = block_table(docs, block_tokens=100)
    lexicon = block_words(blocks, []).groupBy("word").agg(F.sum("c7").alias("c")).where("c > 0")
    junctions = block_junctions(blocks).groupBy("key").agg(F.sum("c").alias("c"))
    got = context_tables(lexicon, lexicon.count(), junctions, junctions.count())
    for table, want in zip(got, plain_tables(texts)):
        used = np.nonzero(table.any(axis=1))[0]
        assert {int(i): table[i].tolist() for i in used} == want


def test_words_in_another_order_score_lower(spark):
    words = ["apple", "bridge", "candle", "dragon", "engine", "falcon", "garden", "hammer"]
    rng, rows = random.Random(5), []
    for i in range(300):
        at = rng.randrange(len(words))
        ordered = [words[(at + k) % len(words)] for k in range(40)]
        mixed = rng.sample(ordered, len(ordered))
        held = zlib.crc32(str(i).encode()) % 5 == 1
        rows += [(i, " ".join(ordered))] + ([(i, " ".join(mixed))] if held else [])
    out = score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("held_out").collect()
    assert out
    for i in {r["doc_id"] for r in out}:
        high, low = sorted((r["score"] for r in out if r["doc_id"] == i), reverse=True)
        assert low < high - 5
    assert len({round(r["base_score"], 6) for r in out}) == 1


def test_starts_after_one_context_sum_to_at_most_one():
    rng = random.Random(7)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 5))) for _ in range(200)}) + [b"\n"]
    codes, end = word_codes(words), len(words) - 1
    ids = np.array([rng.choice([0, 5, 9, end, rng.randrange(len(words))]) for _ in range(3000)] + [end])
    keys, counts = np.unique(junction_keys(ids, *codes, end), return_counts=True)
    table_sums, train, score = model_code()
    tables = table_sums(keys, counts)
    weights, _, apm = train(keys, counts, tables)
    starts = np.unique(codes[0])
    for before in (b"   ", b" ab", b"a b", b"zzz"):
        p = 10 ** score(starts | int.from_bytes(before, "big") << 24, np.zeros(len(starts)), tables, weights, apm)
        assert 0.2 < p.sum() <= 1 + 1e-9


def test_packed_numbers_round_trip():
    pack, unpack = packed_numbers()
    for values in ([], [0], [127, 128, 0, 16383, 16384, 1 << 40, (1 << 48) - 1], list(range(300))):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values
