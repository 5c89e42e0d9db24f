"""Sector exposure of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
CONCENTRATION_PCT = 40.0


def last_close(prices: DataFrame) -> DataFrame:
    """Last known close of each symbol: what a forward fill leaves on the last day."""
    return prices.where("close is not null").groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))


def weights(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """``symbol, quantity, last_close, market_value, weight`` of the positions that have a price and a quantity."""
    held = positions.where("quantity <> 0").join(last_close(prices), "symbol")
    held = held.withColumn("market_value", F.col("last_close") * F.col("quantity"))
    total = held.agg(F.sum("market_value").alias("__total"))
    return held.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide("market_value", "__total")).drop("__total")


def with_sector(df: DataFrame, meta: DataFrame) -> DataFrame:
    return df.join(meta.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))


def sector_weights(weighted: DataFrame, meta: DataFrame) -> DataFrame:
    return with_sector(weighted, meta).groupBy("sector").agg((F.sum("weight") * 100).alias("weight_pct"), F.count(F.lit(1)).alias("n_holdings"))


def by_weight(by_sector: DataFrame) -> DataFrame:
    """Sectors by weight, largest first."""
    return by_sector.orderBy(F.desc("weight_pct"), "sector")


def macro_by_symbol(weighted: DataFrame, meta: DataFrame) -> DataFrame:
    """Each holding's sector and that sector's share of the book."""
    w = Window.partitionBy("sector")
    return with_sector(weighted, meta).select("symbol", "sector", (F.sum("weight").over(w) * 100).alias("sector_weight_pct"))


def macro_portfolio(by_sector: DataFrame) -> DataFrame:
    """One row: top sector, known sectors, effective number, concentration, unknown share."""
    known = F.col("sector") != UNKNOWN
    share = F.col("weight_pct") / 100
    out = by_sector.agg(
        F.max_by("sector", F.struct("weight_pct", "sector")).alias("top_sector"), F.max("weight_pct").alias("top_sector_pct"),
            F.count_if(known).alias("num_sectors"),
        (1 / F.sum(share * share)).alias("effective_sectors"), F.max(F.when(known, F.col("weight_pct"))).alias("__known"),
            F.coalesce(F.sum(F.when(~known, F.col("weight_pct"))), F.lit(0.0)).alias("unknown_pct"),
    )
    level = F.when(F.col("__known") >= CONCENTRATION_PCT, "high").when(F.col("__known") >= 25, "moderate").when(F.col("__known").isNotNull(), "low")
    return out.withColumn("concentration", level).drop("__known")
