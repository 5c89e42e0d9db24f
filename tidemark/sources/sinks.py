"""Writers: last-write-wins tables, append-only logs, replacement by key, and the ingest batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.operators.pit import append_new, changed_rows, latest_by, upsert


def write_upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str, stamp: str = "ingested_at") -> None:
    """Write the merge of ``old`` and ``new``; ``path`` must not be where ``old`` is read from."""
    upsert(old, new, keys, stamp).write.mode("overwrite").parquet(path)


def append_vintages(log: DataFrame, old: DataFrame, new: DataFrame, vintage: Column, path: str) -> None:
    """Append what changed since ``old``, stamped with its vintage; a key of the log is written once."""
    moved = changed_rows(old, new, ["symbol", "date"], ["close", "adj_close"], ("volume",)).withColumn("vintage_date", vintage)
    append_new(log, moved, ["symbol", "date", "vintage_date"]).select("symbol", "date", "vintage_date", "close", "adj_close",
        "volume").write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions of ``keys`` that ``df`` holds, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def shaped_bars(df: DataFrame) -> DataFrame:
    """Vendor bars as stored: lower-case names, rows without a close dropped, NaN volume null."""
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.withColumns({"close": number("close"), "volume": number("volume").cast("bigint")}).where("close is not null")


def shaped_quarters(wide: DataFrame) -> DataFrame:
    """Line items by quarter columns (``symbol, item`` and a column for each ISO date) as one row a quarter."""
    dates = [c for c in wide.columns if c not in ("symbol", "item")]
    long = wide.unpivot(["symbol", "item"], dates, "period_end", "value")
    pick = lambda name: F.max(F.when(F.col("item") == name, F.col("value").cast("double"))).alias(name)
    names = ("total_revenue", "operating_income", "net_income", "gross_profit")
    return long.groupBy("symbol", F.to_date("period_end").alias("period_end")).agg(*map(pick, names)).where("total_revenue is not null")


def shaped_news(df: DataFrame) -> DataFrame:
    """Titles trimmed and cut to 500 characters, rows without one left out, unreadable dates null. Of a title that a
    symbol has twice the one published last stays."""
    out = df.withColumns({"title": F.substring(F.trim("title"), 1, 500), "published": F.try_to_timestamp(F.col("published"))})
    return latest_by(out.where("title <> ''"), ["symbol", "title"], F.col("published"))


def replaced_news(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with all news of the symbols that ``new`` has replaced by those of ``new``; the rest stays."""
    shaped = shaped_news(new)
    return old.join(shaped.select("symbol").distinct(), "symbol", "left_anti").unionByName(shaped, allowMissingColumns=True)


def refresh_news(symbol: str, news: DataFrame, fetch: Callable[[str], DataFrame] | None, hours: int = 24,
    force: bool = False) -> tuple[DataFrame, dict]:
    """``(news, status)``: the symbol's news fetched anew if the newest is older than ``hours``. Without a ``fetch``, or
    when it fails, the news stay as they are and the status says why."""
    fresh = is_fresh(news.where(F.col("symbol") == symbol), hours).first()
    if not force and fresh is not None and fresh.fresh:
        return news, {"fetched": False, "reason": f"newer than {hours} hours"}
    if fetch is None:
        return news, {"fetched": False, "reason": "no source of news"}
    try:
        got = fetch(symbol).withColumns({"symbol": F.lit(symbol), "ingested_at": F.current_timestamp()})
        n = got.count()
    except Exception as e:  # noqa: BLE001  news are best effort
        return news, {"fetched": False, "reason": f"failed: {e}"}
    return replaced_news(news, got), {"fetched": True, "n": n}


def parse_news(raw: Column) -> Column:
    """Items of the first JSON array in a text that have a headline; null where none can be read."""
    items = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1),
        "array<struct<headline: string, publisher: string, date: string, summary: string>>")
    return F.filter(items, lambda x: x["headline"].isNotNull())


def ingest(symbols: list[str], feeds: dict[str, Callable[[str], None]], main: str = "bars") -> dict[str, list[str]]:
    """Run the feeds of each symbol once, in order. The main feed's failure skips the symbol; the others are best
    effort. Gives the errors by symbol."""
    errors: dict[str, list[str]] = {}
    for symbol in dict.fromkeys(symbols):
        for name, feed in sorted(feeds.items(), key=lambda f: f[0] != main):
            try:
                feed(symbol)
            except Exception as e:  # noqa: BLE001  recorded, and the batch goes on
                errors.setdefault(symbol, []).append(f"{name}: {e}")
                if name == main:
                    break
    return errors


def ownership_rows(df: DataFrame) -> DataFrame:
    """Vendor ownership snapshots as stored: rows without either share are no reading."""
    return df.where("held_pct_institutions is not null or held_pct_insiders is not null")


def store_guidance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Guidance records with ``new`` ones in place of those of the same symbol, source and period."""
    return upsert(old, new, ["symbol", "source", "period"], "extracted_at")


def is_fresh(df: DataFrame, hours: int, stamp: str = "ingested_at") -> DataFrame:
    """``symbol, fresh``: whether the newest row is younger than ``hours``."""
    return df.groupBy("symbol").agg((F.max(stamp) > F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours))).alias("fresh"))


def cut_then_write(df: DataFrame, path: str) -> None:
    """Replace a table by rows that are made whole first, so that a failure while they are made leaves it as it was."""
    cut(df).write.mode("overwrite").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
