"""Command line: list the queries, run one over a folder of Parquet tables, show its plan or its SQL."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gavelflow")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    show = commands.add_parser("sql", help="the SQL that gives the same rows, where there is any")
    show.add_argument("name")
    for command in ("run", "explain"):
        c = commands.add_parser(command)
        c.add_argument("name")
        c.add_argument("--data", required=True, help="folder of NAME.parquet tables")
        c.add_argument("--out", help="folder for the result as Parquet; else the first rows are printed")
        c.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)

    from gavelflow import registry

    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if args.name not in registry.QUERIES:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    if args.command == "sql":
        print(registry.SQL.get(args.name, "-- none"))
        return 0
    from pyspark.sql import SparkSession

    result = registry.QUERIES[args.name](SparkSession.builder.getOrCreate(), args.data)
    if args.command == "explain":
        result.explain("formatted")
    elif args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
