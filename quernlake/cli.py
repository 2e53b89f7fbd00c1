"""Command line: ``python -m quernlake -e "SELECT 1"``, a file of statements, a pipe or a prompt."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from quernlake.plans.engine import Engine
from quernlake.plans.lexer import statements
from quernlake.session import build


def show(df: DataFrame, as_json: bool, limit: int) -> str:
    rows = df.take(limit + 1) if limit else df.collect()
    more = bool(limit) and len(rows) > limit
    rows = rows[:limit] if limit else rows
    if as_json:
        return json.dumps({"columns": df.columns, "rows": [[x if isinstance(x, (int, float, bool, str)) or x is None else str(x) for x in r] for r in rows], "count": len(rows)})
    cells = [df.columns, *[["NULL" if x is None else str(x) for x in r] for r in rows]]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in cells]
    lines.insert(1, "-+-".join("-" * w for w in width))
    return "\n".join([*lines, f"({len(rows)} rows{', more not shown' if more else ''})"])


def run(engine: Engine, text: str, as_json: bool, limit: int, out=None) -> None:
    for ts in statements(text):
        got = engine._statement(ts, ())
        if isinstance(got, DataFrame):
            print(show(got, as_json, limit), file=out)
        elif as_json:
            print(json.dumps({"rows_affected": got.rows_affected}), file=out)
        else:
            print(f"{got.rows_affected} rows affected", file=out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernlake", description=__doc__)
    p.add_argument("-d", "--db", default="memory://", help="file://<path> or memory://")
    p.add_argument("-j", "--json", action="store_true", help="results as JSON")
    p.add_argument("-q", "--quiet", action="store_true", help="no connection messages")
    p.add_argument("-l", "--limit", type=int, default=40, help="rows to show, 0 for all")
    p.add_argument("-e", "--execute", help="run a statement and end")
    p.add_argument("-f", "--file", help="run the statements of a file")
    a = p.parse_args(argv)
    spark = build()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, a.db)
    if not a.quiet and not a.json:
        print(f"Connected to database: {a.db}")
    try:
        if a.execute:
            run(engine, a.execute, a.json, a.limit)
        elif a.file:
            with open(a.file, encoding="utf-8") as f:
                run(engine, f.read(), a.json, a.limit)
        elif not sys.stdin.isatty():
            run(engine, sys.stdin.read(), a.json, a.limit)
        else:
            while True:
                try:
                    line = input("> ")
                except EOFError:
                    break
                if line.strip().lower() in ("exit", "quit", "\\q"):
                    break
                try:
                    run(engine, line, a.json, a.limit)
                except Exception as e:  # a prompt goes on after errors
                    print(f"Error: {e}", file=sys.stderr)
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    finally:
        engine.close()
    return 0
