"""Commands over a store: a folder with a book (positions.csv) and Parquet tables of feeds, chunks and past runs.

Paths are Spark's, so a store may lie wherever the cluster reads; only the book is a file of this machine.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analysis, coverage, evaluate, history, rag, risk
from tidemark.plans import runtime
from tidemark.sources import files, sinks, vendor

TABLES = {"bars": "prices", "quarters": "quarters", "meta": "sectors", "news": "news", "ownership": "ownership"}
SHOWN = ("place", "symbol", "weight_pct", "risk_contribution_pct", "attention", "confidence_level", "alerts")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.book = spark, path, os.path.join(path.removeprefix("file://"), "positions.csv")

    def table(self, name: str) -> DataFrame | None:
        """A table of the store; None if it isn't there."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def positions(self) -> DataFrame:
        return files.read_positions(self.spark, f"{self.path}/positions.csv")

    def held(self) -> list[tuple[str, float, float | None]]:
        return [tuple(r) for r in self.positions().collect()] if os.path.exists(self.book) else []

    def prices(self) -> DataFrame:
        found = self.table("prices")
        if found is None:
            raise SystemExit(f"{self.path}: no prices; run ingest first")
        return found.withColumn("adj_close", F.coalesce("adj_close", "close"))

    def feeds(self, market: str | None) -> analysis.Feeds:
        p = self.prices()
        sectors, news = self.table("sectors"), self.table("news")
        return analysis.Feeds(p, p.where(F.col("symbol") == market) if market else None, self.table("quarters"), sectors, None if news is None else
            news.withColumns({"text": F.col("title"), "published": F.to_date("published")}), self.table("ownership"), self.table("guidance"),
            self.table("filings"))


def options_of(args: argparse.Namespace) -> analysis.Options:
    days, _ = risk.horizon(args.horizon)
    return analysis.Options(args.as_of, days, risk.month_ends if args.monthly else lambda p: p, 12 if args.monthly else risk.YEAR_DAYS)


def holdings(store: Store, args: argparse.Namespace) -> None:
    for symbol, quantity, cost in store.held():
        print(f"{symbol:>12} {files.format_quantity(quantity):>12} {'—' if cost is None else files.format_quantity(cost):>12}")


def add(store: Store, args: argparse.Namespace) -> None:
    files.write_positions(files.edited(store.held(), args.symbol, args.quantity, args.avg_cost), store.book)


def remove(store: Store, args: argparse.Namespace) -> None:
    left = files.edited(store.held(), args.symbol, None)
    if len(left) == len(store.held()):
        raise SystemExit(f"{args.symbol}: not held")
    files.write_positions(left, store.book)


def ingest(store: Store, args: argparse.Namespace) -> None:
    """Refresh the tables from a vendor: each feed is read by symbol, side by side. A feed that fails leaves its table as
    it was, and only the bars' failure ends the command."""
    vendor.register(store.spark)
    symbols = ",".join(args.symbols or sorted(s for s, _, _ in store.held()))
    for feed, name in TABLES.items():
        read = store.spark.read.format("vendor").options(source=args.source, symbols=symbols, feed=feed).load()
        try:
            sinks.cut_then_write(read.withColumn("ingested_at", F.current_timestamp()), f"{store.path}/{name}")
        except Exception as e:
            if feed == "bars":
                raise
            print(f"{feed}: {str(e).splitlines()[0]}")
    print(f"{store.table('prices').count()} bars")


def check(store: Store, args: argparse.Namespace) -> None:
    coverage.data_check(store.prices()).orderBy("symbol").show(1000, truncate=False)


def show_risk(store: Store, args: argparse.Namespace) -> None:
    """Positions by share of risk, and the whole book."""
    feeds, options = store.feeds(args.market), options_of(args)
    rows = risk.by_risk(analysis.position_risk(store.positions(), feeds, options))
    for r in rows.limit(args.first).collect():
        print(f"{r.symbol:>12}  weight {_n(r.weight_pct)}%  risk {_n(r.risk_contribution_pct)}%  vol {_n(r.vol_pct)}%  beta {_n(r.beta, 2)}")
    p = analysis.portfolio(store.positions(), feeds, options).first()
    print(f"book: {p.n_positions} positions, vol {_n(p.portfolio_vol_pct)}%, top risk {p.top_symbol} {_n(p.top_risk_pct)}%, effective holdings {_n(p.effective_holdings)}")


def _n(x: float | None, places: int = 1) -> str:
    return "—" if x is None else f"{x:.{places}f}"


def analyze(store: Store, args: argparse.Namespace) -> None:
    """What each reading says, the cards by share of risk with what changed since the last run, and a snapshot of it."""
    before = store.table("runs")
    prior = None if before is None else history.latest_by(before, ["symbol"], F.col("run_at"))

    def told(kind: str, what: dict) -> None:
        if kind == "agent_done" and what["there"]:
            print(f"{what['agent']:>12}: {what['note']}")

    cards = runtime.analyse_book(store.positions(), store.feeds(args.market), options_of(args), told, prior, args.first)
    _print_cards(cards.where(F.col("place") <= args.first).orderBy("place"))
    if not args.no_snapshot:
        history.save_run(cards, args.as_of, f"{store.path}/runs")


def briefing(store: Store, args: argparse.Namespace) -> None:
    """The names that ask for attention, most first."""
    cards = analysis.cards(store.positions(), store.feeds(args.market), options_of(args))
    _print_cards(cards.where("size(alerts) > 0").orderBy(F.desc_nulls_last("attention"), "symbol").limit(args.first))


def _print_cards(cards: DataFrame) -> None:
    for r in cards.select(*SHOWN).collect():
        print(f"{r.place:>4} {r.symbol:>12}  risk {_n(r.risk_contribution_pct)}%  attention {_n(r.attention)}  {r.confidence_level:<6}  {' | '.join(r.alerts)}")


def back_test(store: Store, args: argparse.Namespace) -> None:
    prices = store.prices() if args.vintage_as_of is None else store.table("vintages")
    quarters = store.table("quarters")
    if prices is None or quarters is None:
        raise SystemExit("a back-test needs prices, or vintages, and quarters")
    out = evaluate.evaluate(prices, quarters, args.horizon, as_of=args.as_of, step=args.step, vintage_asof=args.vintage_as_of)
    out.orderBy("kind", "signal").show(50, truncate=False)


def docs(store: Store, args: argparse.Namespace) -> None:
    """Index the texts of a folder or file for a symbol; without a path, list what is there."""
    if args.path:
        texts = files.read_documents(store.spark, args.path)
        index = rag.indexed_chunks(texts, f"{store.path}/index-{args.symbol.upper()}", "source", "text")
        print(f"{index.rows().count()} chunks")
    else:
        for r in rag.CellIndex(store.spark, f"{store.path}/index-{args.symbol.upper()}").rows().groupBy("source").count().orderBy("source").collect():
            print(f"{r['source']}: {r['count']} chunks")


def ask(store: Store, args: argparse.Namespace) -> None:
    """The evidence for a question, nearest first, and whether even the best is far."""
    index = rag.CellIndex(store.spark, f"{store.path}/index-{args.symbol.upper()}")
    asked = store.spark.createDataFrame([(args.question,)], "question string")
    for r in rag.retrieve_indexed(asked, index, args.k).orderBy("rank").collect():
        print(f"[{r['rank']}] {r.distance:.3f}{' weak' if r.weak else ''}  {r.content[:200]}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m tidemark", description="Commands over a store of a book and its feeds.")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[Store, argparse.Namespace], None]) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=(run.__doc__ or name).split(".")[0])
        p.add_argument("store")
        p.set_defaults(run=run)
        return p

    command("holdings", holdings)
    p = command("add", add)
    p.add_argument("symbol")
    p.add_argument("quantity", type=float)
    p.add_argument("avg_cost", type=float, nargs="?")
    command("remove", remove).add_argument("symbol")
    p = command("ingest", ingest)
    p.add_argument("--source", required=True, help="module:factory of a vendor's feeds")
    p.add_argument("--symbols", nargs="*", help="else those of the book")
    command("coverage", check)
    for name, run in (("risk", show_risk), ("analyze", analyze), ("briefing", briefing)):
        p = command(name, run)
        p.add_argument("--as-of", help="day that the analysis knows of")
        p.add_argument("--horizon", default="annual", help="d, w, m, q, y or a number of days")
        p.add_argument("--monthly", action="store_true", help="compare returns by month, for bars with gaps")
        p.add_argument("--market", help="symbol of the benchmark's bars")
        p.add_argument("--first", type=int, default=20, help="rows shown")
        if name == "analyze":
            p.add_argument("--no-snapshot", action="store_true")
    p = command("eval", back_test)
    p.add_argument("--horizon", type=int, default=21)
    p.add_argument("--step", type=int, default=5)
    p.add_argument("--as-of")
    p.add_argument("--vintage-as-of", help="use the bars as they were known on this day")
    p = command("docs", docs)
    p.add_argument("symbol")
    p.add_argument("path", nargs="?")
    p = command("ask", ask)
    p.add_argument("symbol")
    p.add_argument("question")
    p.add_argument("-k", type=int, default=4)
    return out


COMMANDS = ("holdings", "add", "remove", "ingest", "coverage", "risk", "analyze", "briefing", "eval", "docs", "ask")


def main(spark: SparkSession, args: list[str]) -> int:
    parsed = parser().parse_args(args)
    parsed.run(Store(spark, parsed.store.rstrip("/")), parsed)
    return 0
