"""``python -m tidemark list`` names the queries, ``run NAME SF_DIR [ROWS]`` shows one's result, ``explain NAME SF_DIR`` its
plan, ``check SF_DIR`` what each symbol has, ``brief SF_DIR [ROWS]`` the names that ask for attention.

Over a store of one's own: holdings, add, remove, ingest, coverage, risk, analyze, briefing, eval, docs, ask (``-h`` tells more)."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from tidemark import commands
from tidemark.plans import books, flows, search  # noqa: F401  they add their queries
from tidemark.plans.catalog import QUERIES
from tidemark.session import session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4) and args[1] in QUERIES:
        QUERIES[args[1]](session(), args[2]).show(int(args[3]) if len(args) == 4 else 20, truncate=False)
        return 0
    if args[:1] == ["explain"] and len(args) == 3 and args[1] in QUERIES:
        QUERIES[args[1]](session(), args[2]).explain("formatted")
        return 0
    if args[:1] == ["check"] and len(args) == 2:
        QUERIES["data_check"](session(), args[1]).orderBy("symbol").show(1000, truncate=False)
        return 0
    if args[:1] == ["brief"] and len(args) in (2, 3):
        asked = QUERIES["cards"](session(), args[1]).orderBy(F.desc_nulls_last("attention"), "symbol")
        for r in asked.limit(int(args[2]) if len(args) == 3 else 20).collect():
            print(f"{r.symbol:>12}  {r.attention!s:>6}  {r.confidence_level:<6}  {r.alerts}")
        return 0
    if args[:1] and args[0] in commands.COMMANDS:
        return commands.main(session(), args)
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
