"""Command line: build the index, recommend for a file of new tickets, or ask
about one ticket.

    python -m precedent.cli build-index --cases DIR --index ROOT [--cache PATH] [--only-resolved]
    python -m precedent.cli recommend --new FILE.csv --index ROOT --out DIR [--category-filter]
    python -m precedent.cli ask --index ROOT --issue TEXT --description TEXT [--category NAME]

The Spark session is the one ``spark-submit`` provides (cluster settings,
``spark.checkpoint.dir``); run directly, a local session is created.
"""

from __future__ import annotations

import argparse
import json
import sys

from precedent.session import get_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="precedent")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build-index", help="read case files and write a new index version")
    b.add_argument("--cases", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--cache")
    b.add_argument("--only-resolved", action="store_true")
    r = sub.add_parser("recommend", help="recommend for every ticket of a CSV file")
    r.add_argument("--new", required=True)
    r.add_argument("--index", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--category-filter", action="store_true")
    a = sub.add_parser("ask", help="recommend for one ticket, printed as markdown")
    a.add_argument("--index", required=True)
    a.add_argument("--issue", required=True)
    a.add_argument("--description", required=True)
    a.add_argument("--category")
    args = ap.parse_args(argv)

    from precedent.plans.jobs import build_index_job, recommend_job, recommend_one

    spark = get_session()
    if args.cmd == "build-index":
        info = build_index_job(spark, args.cases, args.index, cache_path=args.cache,
                               only_resolved=args.only_resolved)
        print(json.dumps(info, indent=2, sort_keys=True))
    elif args.cmd == "recommend":
        summary = recommend_job(spark, args.new, args.index, args.out,
                                category_filter=args.category_filter).first().asDict()
        print(json.dumps(summary, indent=2, sort_keys=True))
    else:
        for row in recommend_one(spark, args.index, args.issue, args.description,
                                 args.category).collect():
            print(row["markdown"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
