"""Command line: evaluate a CSV, run a registered query, list the queries."""

from __future__ import annotations

import argparse
import json
import sys

from lucidra.session import get_session


def _levels(items: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for x in items:
        column, _, levels = x.partition("=")
        if not column or not levels:
            raise SystemExit(f"--expect-level wants COLUMN=A,B, not {x!r}")
        out[column] = levels.split(",")
    return out


def main(argv: list[str] | None = None) -> int:
    """Entry point; the exit code is 0 unless a check fails."""
    p = argparse.ArgumentParser(prog="lucidra", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate", help="the report of one scored CSV as JSON")
    e.add_argument("csv")
    e.add_argument("--bins", type=int, default=10)
    e.add_argument("--threshold", type=float, action="append")
    e.add_argument("--group-column", action="append", default=[])
    e.add_argument("--interaction", action="append", default=[], help="columns joined by *")
    e.add_argument("--expect-level", action="append", default=[])
    e.add_argument("--minimum-level-count", type=int, default=1)
    e.add_argument("--minimum-interaction-count", type=int, default=1)
    e.add_argument("--legacy", action="store_true")
    q = sub.add_parser("query", help="run a registered query and write it as parquet, or show it")
    q.add_argument("name")
    q.add_argument("data")
    q.add_argument("--out")
    sub.add_parser("list", help="names of the registered queries")
    a = p.parse_args(argv)
    from lucidra.plans import registry

    if a.command == "list":
        print("\n".join(registry.queries()))
        return 0
    spark = get_session()
    if a.command == "query":
        df = registry.queries()[a.name](spark, a.data)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=False)
        return 0
    from lucidra.operators.evaluate import evaluate
    from lucidra.sources.io import read_csv_strings

    try:
        r = evaluate(
            read_csv_strings(spark, a.csv), a.group_column, [x.split("*") for x in a.interaction], a.threshold, a.bins, _levels(a.expect_level), a.minimum_level_count, a.minimum_interaction_count, a.legacy
        )
    except (ValueError, KeyError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    rows = lambda df: None if df is None else [x.asDict() for x in df.collect()]
    out = {"identity": r.identity, "overall": rows(r.overall), "groups": {k: rows(v) for k, v in r.groups.items()}, "interactions": {k: rows(v) for k, v in r.interactions.items()}, "policy_frontier": rows(r.frontier)}
    print(json.dumps(out, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
