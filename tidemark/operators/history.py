"""Run history: snapshots and briefs as append-only rows, read back newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import parsed, text_at, there
from tidemark.operators.pit import latest_by
from tidemark.operators.scoring import snapshot

SEARCH_FEE = 0.02
RUNS = "symbol string, run_at timestamp, model string, cost_usd double, one_line string, payload string"


def save_run(scored: DataFrame, as_of: str | None, path: str) -> None:
    """Append a snapshot row for each card of a run."""
    rows = snapshot(scored).withColumns({"as_of": F.lit(as_of).cast("date"), "run_at": F.current_timestamp()})
    rows.write.mode("append").parquet(path)


def brief_rows(verdicts: DataFrame, facts: DataFrame, model: str, price_in: float, price_out: float) -> DataFrame:
    """Briefs as history rows. ``verdicts``: ``symbol, one_line`` or ``headline``, what else the model said, and the
    tokens of the call and of the news search (``input_tokens, output_tokens, news_input, news_output, searched``);
    ``facts`` are snapshots by symbol. Null numbers are left out of the payload, as JSON asks for."""
    said = [c for c in verdicts.columns if c not in ("symbol", "input_tokens", "output_tokens", "news_input", "news_output", "searched")]
    kind = "deep" if "headline" in said else "verdict"
    facts = facts.select("symbol", F.struct(*[c for c in facts.columns if c != "symbol"]).alias("snapshot"))
    payload = F.to_json(F.struct(F.struct(*said).alias(kind), "snapshot"))
    cost = run_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("news_input"), F.col("news_output"), F.col("searched"), price_in, price_out)
    return verdicts.join(facts, "symbol", "left").select(
        "symbol", F.current_timestamp().alias("run_at"), F.lit(model).alias("model"), cost.alias("cost_usd"),
        F.col("headline" if kind == "deep" else "one_line").alias("one_line"), payload.alias("payload"),
    )


def run_cost(
    tokens_in: Column, tokens_out: Column, news_in: Column, news_out: Column, searched: Column, price_in: float, price_out: float,
    news_price_in: float | None = None, news_price_out: float | None = None,
) -> Column:
    """Dollars of one brief or deep read, to four places: its call, and the news call and search fee if one was made.
    A deep read has prices of its own; its news come at ``news_price_in`` and ``news_price_out``."""
    calls = lambda i, o, a, b: F.coalesce(i, F.lit(0)) / 1e6 * a + F.coalesce(o, F.lit(0)) / 1e6 * b
    news = calls(news_in, news_out, price_in if news_price_in is None else news_price_in, price_out if news_price_out is None else news_price_out)
    return F.round(calls(tokens_in, tokens_out, price_in, price_out) + F.when(searched, news + SEARCH_FEE).otherwise(0.0), 4)


def total_cost(runs: DataFrame) -> DataFrame:
    """One row ``runs, cost_usd``; runs without a price count nothing."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def runs_of(history: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    """A name's runs, newest first."""
    return recent_runs(history.where(F.col("symbol") == symbol.upper()), limit)


def recent_runs(history: DataFrame, limit: int = 30) -> DataFrame:
    """The newest runs over all names; a sort that keeps ``limit`` rows a task."""
    return history.orderBy(F.desc("run_at"), "symbol").limit(limit)


def deep_summaries(history: DataFrame) -> DataFrame:
    """``symbol, summary``: headline and bottom line of each name's latest run that is a deep read."""
    rows = parsed(history, "payload", "__v").where(there("__v", "$.deep"))
    parts = rows.select("symbol", "run_at", text_at("__v", "$.deep.headline").alias("a"), text_at("__v", "$.deep.bottom_line").alias("b"))
    last = latest_by(parts, ["symbol"], F.col("run_at"))
    return last.select("symbol", F.nullif(F.concat_ws(" — ", "a", "b"), F.lit("")).alias("summary"))


def with_changes(scored: DataFrame, history: DataFrame, changes) -> DataFrame:
    """Snapshots of a run with what changed since each name's last one; :func:`scoring.changes` is passed in."""
    return changes(snapshot(scored), latest_by(history, ["symbol"], F.col("run_at")))


def web_sources(sources: DataFrame) -> DataFrame:
    """Sources of an answer once each by url, in the order they came (``ord``); without a title the url stands for it."""
    there = sources.where("url is not null and url <> ''").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "url"))
    return there.groupBy("url").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord")).orderBy("ord")
