"""A shell: ``python -m millrace WAREHOUSE [-e STATEMENTS] [--strict-like]``.

Without -e it reads statements, each ended by a semicolon, until ``exit`` or ``quit``;
``history`` lists those that ran.
"""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from millrace.dialect import DialectError
from millrace.session import Warehouse, spark_session


def show(df, rows: int, out: TextIO) -> None:
    """The column names, a rule and the first rows."""
    if df is None:
        print("OK", file=out)
        return
    print(" | ".join(df.columns), "-" * 40, sep="\n", file=out)
    for r in df.limit(rows).toLocalIterator():
        print(" | ".join("NULL" if x is None else str(x) for x in r), file=out)


def run(w: Warehouse, text: str, rows: int, out: TextIO) -> bool:
    """Whether the statements went well; what they return is shown."""
    try:
        show(w.sql(text), rows, out)
        return True
    except (DialectError, LookupError, ValueError) as e:
        print(f"error: {e}", file=out)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0]}", file=out)
    return False


def shell(w: Warehouse, source: TextIO, rows: int, out: TextIO) -> None:
    held = ""
    for line in source:
        word = line.strip().lower().rstrip(";")
        if not held and word in ("exit", "quit"):
            return
        if not held and word == "history":
            print(*w.history, sep="\n", file=out)
            continue
        held += line
        if line.rstrip().endswith(";") or line.startswith("\\"):
            run(w, held, rows, out)
            held = ""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("warehouse")
    p.add_argument("-e", "--execute")
    p.add_argument("--strict-like", action="store_true")
    p.add_argument("--rows", type=int, default=100)
    a = p.parse_args(argv)
    w = Warehouse(spark_session(), a.warehouse, a.strict_like)
    if a.execute:
        return 0 if run(w, a.execute, a.rows, sys.stdout) else 1
    shell(w, sys.stdin, a.rows, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
