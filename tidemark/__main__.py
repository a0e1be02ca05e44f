"""Command line: list the queries, run one, or check a store.

    python -m tidemark list
    python -m tidemark run NAME --tables DIR [--out PATH | --compare PATH]
    python -m tidemark check STORE
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__.splitlines()[0])
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    run = verbs.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("--tables", required=True, help="folder with <table>.parquet")
    run.add_argument("--out", help="write the result here; it must not exist yet")
    run.add_argument("--compare", help="write the result, or fail if another one is there")
    check = verbs.add_parser("check", help="verify a store against its manifest, without writing")
    check.add_argument("store")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from . import registry

    if args.verb == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if args.verb == "run" and args.name not in registry.QUERIES:
        print(f"no query {args.name!r}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .sources import stores, tables

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.verb == "check":
            print(f"{stores.check_store(spark, args.store)} days are as the manifest says")
            return 0
        found = registry.QUERIES[args.name](spark, args.tables)
        if args.compare:
            print("written" if tables.write_or_compare(found, args.compare) else "the same result is there")
        elif args.out:
            tables.write_once(found, args.out)
        else:
            found.show(50, truncate=False)
        return 0
    except tables.DataError as e:
        print(f"rejected: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
