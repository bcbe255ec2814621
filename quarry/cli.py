"""Command line: list, show, run and bench the registered queries."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from quarry.plans.queries import QUERIES
    from quarry.session import session

    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("show", "run", "explain"):
        c = sub.add_parser(name)
        c.add_argument("query", choices=sorted(QUERIES))
        c.add_argument("tables", help="folder of the input tables")
        if name == "run":
            c.add_argument("out", help="folder for the result")
    args = p.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[args.query](session(), args.tables)
    if args.command == "show":
        df.show(truncate=80)
    elif args.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
