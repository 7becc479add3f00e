"""What a task holds at a time, measured with tracemalloc on the functions that run in tasks."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyspark
from kgprep.llm import jaccard_join, scoring
from kgprep.llm.substring_dedup import repeated_windows


class Steps:
    """In place of a table: remembers the function that would run in tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def peak(work):
    """(result, bytes) of ``work()``: what it allocated at most."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_arrays_hold_few_numbers_a_byte():
    rng = np.random.default_rng(4)
    segments = [rng.integers(97, 101, 2000, dtype=np.uint8).tobytes() for _ in range(150)]
    segments += segments[:20]
    hits, size = peak(lambda: repeated_windows(400)(segments))
    assert [bool(h.all()) for h in hits] == [True] * 20 + [False] * 130 + [True] * 20
    assert size < 100 * sum(map(len, segments))


def test_junctions_are_worked_out_a_few_texts_at_a_time(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array([False] * len(texts)), pa.array(texts)],
                                       ["doc_id", "held_out", "text"])

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    monkeypatch.setattr(scoring, "written", lambda rows, *_: rows)
    monkeypatch.setattr(scoring, "KEYS", 10_000, raising=False)
    steps = scoring.block_table(Steps())
    tokens = 401 * len(texts)
    rows, size = peak(lambda: [r for b in steps.run([batch]) for r in b.to_pylist()])
    assert size < 25 * tokens
    junctions = [r for r in rows if r["kind"] == 2]
    unpack = scoring.packed_numbers()[1]
    want = {}
    for text in texts:
        data = b"   " + text.encode() + b" \n\0\0"
        starts = [i for i in range(3, len(data) - 2) if data[i] != 32 and (data[i - 1] == 32)]
        for i in starts:
            start = data[i:i + 3] if data[i:i + 1] != b"\n" else b"\n\0\0"
            start = start[:2] + b"\0" if start[1:2] == b" " else start
            before = data[i - 4:i - 1] if i > 3 else b"   "
            key = int.from_bytes(before + start, "big")
            want[key] = want.get(key, 0) + 1
    got = dict(zip(np.cumsum(unpack(junctions[0]["a"])).tolist(), unpack(junctions[0]["b"]).tolist()))
    assert len(junctions) == 1 and got == want


def test_counts_of_distinct_keys_are_added():
    rng, total, want = np.random.default_rng(8), (np.zeros(0, np.int64),) * 2, {}
    for n in (0, 50, 1, 300, 0):
        keys = np.sort(rng.integers(0, 200, n))
        total = scoring.summed(total, scoring.distinct(keys))
        for k in keys.tolist():
            want[k] = want.get(k, 0) + 1
    assert total[0].tolist() == sorted(want) and total[1].tolist() == [want[k] for k in sorted(want)]


def test_common_members_sort_a_batch_in_place(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(100)) for _ in range(2000)]
    texts += texts[:100] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    class Stop(Exception):
        pass

    class Counted(Steps):
        def mapInArrow(self, run, schema):
            Counted.step = staticmethod(run)
            raise Stop

    try:
        jaccard_join.common_members(Counted(), 3, 8, 1 << 20)
    except Stop:
        pass
    found, size = peak(lambda: [b.to_pydict() for b in Counted.step([batch])])
    members = jaccard_join.shingle_set(3)
    want = {int(m) for t in texts[:100] for m in members(t).astype(np.int64)}
    assert set(found[0]["m"]) == want and set(found[0]["n"]) == {2}
    assert size < 3.5 * 8 * 98 * len(texts)
