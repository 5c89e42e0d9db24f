"""Technical reads: one aggregate brings a symbol's bars into arrays, all measures are expressions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import terminal_macd, terminal_rsi
from tidemark.functions.windows import rolling_mean, rows_of

MIN_ROWS, YEAR_ROWS = 30, 252


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _tail(values: Column, n: int, skip: int = 0) -> Column:
    """The last ``n`` values before the last ``skip`` ones."""
    return F.slice(values, F.greatest(F.size(values) - n - skip + 1, F.lit(1)), n)


def _sma(values: Column, n: int) -> Column:
    return F.when(F.size(values) >= n, _mean(_tail(values, n)))


def _back(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.try_divide(F.element_at(values, -1), F.try_element_at(values, F.lit(-1 - n))) - 1)


def trend(last: Column, sma50: Column, sma200: Column) -> Column:
    above = lambda s: F.when(last > s, "uptrend").otherwise("downtrend")
    sideways = sma50.isNotNull() & (F.abs(last / sma200 - 1) < 0.02)
    return F.when(sma200.isNotNull(), F.when(sideways, "sideways").otherwise(above(sma200))).when(sma50.isNotNull(), above(sma50)).otherwise("—")


def momentum(rsi: Column) -> Column:
    return F.when(rsi >= 70, "overbought").when(rsi >= 55, "strong").when(rsi <= 30, "oversold").when(rsi <= 45, "weak").otherwise("neutral")


def level(from_high: Column) -> Column:
    return F.when(from_high >= -0.05, "at highs").when(from_high <= -0.25, "near lows").otherwise("mid-range")


def technical(prices: DataFrame) -> DataFrame:
    """One row for each symbol with at least 30 closes. A symbol's history is thousands of rows at most, so its arrays
    are small; symbols spread over tasks."""
    bars = prices.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(F.col("close").isNotNull(), F.struct("date", "close")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("volume").isNotNull(), F.struct("date", "volume")))).alias("v"),
    )
    a = bars.select("symbol", F.transform("c", lambda x: x["close"]).alias("s"), F.transform("v",
        lambda x: x["volume"].cast("double")).alias("v")).where(F.size("s") >= MIN_ROWS)
    s, v = F.col("s"), F.col("v")
    recent, prior = _mean(_tail(v, 20)), _mean(_tail(v, 20, 20))
    out = a.select(
        "symbol", F.element_at(s, -1).alias("last_close"), _sma(s, 20).alias("sma20"), _sma(s, 50).alias("sma50"), _sma(s,
            200).alias("sma200"), terminal_rsi(s).alias("rsi_14"),
        terminal_macd(s).alias("m"), (F.element_at(s, -1) / F.array_max(_tail(s, YEAR_ROWS)) - 1).alias("from_high"), _back(s,
            21).alias("ret_1m"), _back(s, 63).alias("ret_3m"),
        F.when(F.size(v) >= 40, F.when(recent > prior * 1.05, "rising").when(recent < prior * 0.95,
            "falling").otherwise("flat")).alias("volume_trend"),
    )
    return out.select(
        "symbol", "last_close", "sma20", "sma50", "sma200", "rsi_14", F.col("m.macd").alias("macd"),
            (F.col("m.macd") - F.col("m.signal")).alias("macd_hist"),
        (F.col("from_high") * 100).alias("pct_from_52w_high"), (F.col("ret_1m") * 100).alias("ret_1m_pct"),
            (F.col("ret_3m") * 100).alias("ret_3m_pct"), "volume_trend",
        trend(F.col("last_close"), F.col("sma50"), F.col("sma200")).alias("trend"), momentum(F.col("rsi_14")).alias("momentum"),
            level(F.col("from_high")).alias("level"),
    )


def price_series(prices: DataFrame, lookback: int = 250) -> DataFrame:
    """Last ``lookback`` bars of each symbol with moving averages over its full history."""
    w, x = rows_of(), F.col("close")
    out = prices.where("close is not null").select("symbol", "date", "close", *[rolling_mean(x, n, w).alias(f"sma{n}") for n in (20, 50, 200)])
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return out.withColumn("n", back).where(F.col("n") <= lookback).drop("n")
