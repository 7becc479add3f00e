"""Bench: headline operators on triples derived from $BENCH_SF_DIR.

Each query's full result is computed with the ``noop`` sink (every row is
produced, nothing goes to the driver).  Each query runs ``$BENCH_RUNS``
times (default 2) and the best time is reported; first-run times are
reported too.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kgprep import session  # noqa: E402
from kgprep.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "s1_parse_ntriples",       # S1: scan + parse N-Triples text
    "d4_entity_dictionary",    # D1+D3: distinct entities, dense ids
    "j4_encode_uri",           # J4: three encoding joins
    "j5_encode_literal",       # J5
    "x4_split_70_15_15",       # X4: exact seeded split per language
    "a5_merge_components",     # A5: connected components over links
    "a4_merge_ordered",        # A4: ordered fold over links
    "w1_encode_graph",         # W1: the whole one-graph job, all outputs
    "s2_read_bz2_ntriples",    # S2: write and scan bz2 text
    "j8_encode_strict",        # J8: lookup encode of a split
    "k5_language_outputs",     # K5: partitioned layout
    "w2_encode_languages",     # W2: per-language dictionaries and encodes
    "w4_two_way",              # W4
    "w5_three_tasks",          # W5
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = sys.argv[1:] or HEADLINE
    # warm the JVM (class loading, codegen caches) on the smallest query
    QUERIES["d2_relations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times, first, errors = {}, {}, {}
    for name in names:
        try:
            for i in range(runs):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = round(time.perf_counter() - t0, 3)
                first.setdefault(name, dt)
                times[name] = min(times.get(name, dt), dt)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {"metric": "total_sec_headline_queries", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
           "runs": runs, "note": f"best of {runs} runs per query; first runs total "
                                 f"{round(sum(first.values()), 3)} sec", "first_run": first}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
