"""Command line: ``python -m kgprep <job> ...`` runs one of the jobs W1-W5.

The session comes from ``SparkSession.builder.getOrCreate()``, so
``spark-submit`` settings (master, executors, ``spark.checkpoint.dir``)
apply unchanged.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kgprep.plans import jobs
from kgprep.schema import OWL_SAME_AS


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="kgprep")
    sub = ap.add_subparsers(dest="job", required=True)
    a = sub.add_parser("encode-graph", help="W1: one N-Triples graph -> dictionaries and encoded triples")
    a.add_argument("input", nargs="+")
    a.add_argument("--out", required=True)
    a.add_argument("--mode", default="FAILFAST", choices=["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
    a.add_argument("--readable", action="store_true")
    a.add_argument("--skew-share", type=float)
    for name, hlp in (("encode-languages", "W2: per-language dictionaries and encodings"),
                      ("encode-all-languages", "W3: dictionaries over all languages")):
        b = sub.add_parser(name, help=hlp)
        b.add_argument("root")
        b.add_argument("--out", required=True)
        b.add_argument("--languages", nargs="+", help="all by default")
        b.add_argument("--datasets", nargs="+", help="all by default")
        b.add_argument("--mode", default="FAILFAST", choices=["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
        b.add_argument("--skew-share", type=float)
    for name, hlp in (("prepare-two-way", "W4: 80/20 split, original and merged ids"),
                      ("prepare-three-tasks", "W5: 70/15/15 split and three tasks")):
        c = sub.add_parser(name, help=hlp)
        c.add_argument("src", help="folder with quads/ entity2id/ relation2id/ links/ (bz2 TSV parts)")
        c.add_argument("--out", required=True)
        c.add_argument("--seed", default="0")
        c.add_argument("--merge", default="component", choices=["component", "ordered"])
        c.add_argument("--link-order", nargs="+", default=["s", "o"], help="columns that order an ordered merge")
        c.add_argument("--skew-share", type=float)
        if name == "prepare-three-tasks":
            c.add_argument("--language", default="es")
            c.add_argument("--predicate", default=OWL_SAME_AS)
    for job in sub.choices.values():
        job.add_argument("--anew", action="store_true", help="write all outputs, also those of an earlier run with the same inputs")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"kgprep {args.job}").getOrCreate()
    if args.job == "encode-graph":
        res = jobs.encode_graph(spark, args.input, args.out, mode=args.mode, readable=args.readable,
                                skew_share=args.skew_share, resume=not args.anew)
    elif args.job == "encode-languages":
        res = jobs.encode_languages(spark, args.root, args.out, args.languages, args.datasets, mode=args.mode,
                                    skew_share=args.skew_share, resume=not args.anew)
    elif args.job == "encode-all-languages":
        res = jobs.encode_all_languages(spark, args.root, args.out, args.languages, args.datasets, mode=args.mode,
                                        skew_share=args.skew_share, resume=not args.anew)
    elif args.job == "prepare-two-way":
        res = jobs.prepare_two_way(spark, args.src, args.out, seed=args.seed, merge_mode=args.merge,
                                   link_order=args.link_order, skew_share=args.skew_share, resume=not args.anew)
    else:
        res = jobs.prepare_three_tasks(spark, args.src, args.out, language=args.language, seed=args.seed,
                                       merge_mode=args.merge, link_order=args.link_order, same_as=args.predicate,
                                       skew_share=args.skew_share, resume=not args.anew)
    print(json.dumps(res))
    return res


if __name__ == "__main__":
    main()
