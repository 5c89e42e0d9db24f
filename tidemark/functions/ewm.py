"""Exponentially weighted recursions: terminal values as folds inside the engine, series by prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scan import ewm, in_blocks, previous


def terminal_ewm(values: Column, alpha: float) -> Column:
    """Last value of y_t = (1 - a) y_{t-1} + a x_t over an array in time order, seeded by its first element."""
    seed = F.struct(F.lit(None).cast("double").alias("y"))
    step = lambda acc, x: F.struct(F.coalesce(acc["y"] * (1 - alpha) + x * alpha, x).alias("y"))
    return F.aggregate(values, seed, step, lambda acc: acc["y"])


def terminal_macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """Struct ``macd, signal`` at the end of an array in time order, by one fold."""
    a, b, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("f"), none.alias("s"), none.alias("g"))

    def step(acc, x):
        f = F.coalesce(acc["f"] * (1 - a) + x * a, x)
        s = F.coalesce(acc["s"] * (1 - b) + x * b, x)
        return F.struct(f.alias("f"), s.alias("s"), F.coalesce(acc["g"] * (1 - c) + (f - s) * c, f - s).alias("g"))

    return F.aggregate(values, zero, step, lambda acc: F.struct((acc["f"] - acc["s"]).alias("macd"), acc["g"].alias("signal")))


def terminal_rsi(values: Column, period: int = 14) -> Column:
    """Wilder's RSI at the end of an array; null under period + 1 values; without losses 100, or 50 if flat."""
    n, alpha = F.size(values), 1 / period
    deltas = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)
    gain = terminal_ewm(F.transform(deltas, lambda d: F.greatest(d, F.lit(0.0))), alpha)
    loss = terminal_ewm(F.transform(deltas, lambda d: F.greatest(-d, F.lit(0.0))), alpha)
    rsi = F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return F.when(n >= period + 1, rsi)


def rsi_series(prices: DataFrame, column: str = "close", period: int = 14) -> DataFrame:
    """``symbol, date, rsi`` of each row with a price; null where there are no losses yet. Two scans by blocks of time."""
    there = prices.select("symbol", "date", column).where(F.col(column).isNotNull())
    moves = previous(in_blocks(there, ["symbol"], "date"), ["symbol"], column, "before").where("before is not null")
    move = F.col(column) - F.col("before")
    # The first row of a symbol has no move, so places are counted anew.
    rows = in_blocks(moves.select("symbol", "date", F.greatest(move, F.lit(0.0)).alias("gain"), F.greatest(-move, F.lit(0.0)).alias("loss"), "__b"),
        ["symbol"], "date", F.col("__b"))
    both = ewm(rows, ["symbol"], {"up": F.col("gain"), "down": F.col("loss")}, 1 / period)
    rsi = both.select("symbol", "date", (100 - 100 / (1 + F.col("up") / F.nullif("down", F.lit(0.0)))).alias("rsi"))
    first = there.groupBy("symbol").agg(F.min("date").alias("date")).withColumn("rsi", F.lit(None).cast("double"))
    return rsi.unionByName(first)


def ewma_vol_series(series: DataFrame, lam: float = 0.94) -> DataFrame:
    """``key, date, ret, sigma``: EWMA volatility of demeaned returns of each ``key``, by a scan."""
    there = series.select("key", "date", "ret").where("ret is not null")
    mean = there.groupBy("key").agg(F.avg("ret").alias("__mean"))
    rows = in_blocks(there.join(mean, "key"), ["key"], "date")
    e = F.col("ret") - F.col("__mean")
    return ewm(rows, ["key"], {"__v": e * e}, 1 - lam).select("key", "date", "ret", F.sqrt("__v").alias("sigma"))
