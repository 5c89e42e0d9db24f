"""Quarterly reads: calendar-matched growth and margins, never by row offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(new: Column, old: Column) -> Column:
    """Percent change over a positive base, else null."""
    return F.when(old > 0, (new / old - 1) * 100)


def growth_bucket(pct: Column) -> Column:
    return F.when(pct >= 15, "strong").when(pct >= 5, "growing").when(pct >= -5, "flat").when(pct.isNotNull(), "declining")


def margin_trend(change_pp: Column) -> Column:
    return F.when(change_pp > 0.5, "expanding").when(change_pp < -0.5, "contracting").when(change_pp.isNotNull(), "stable")


def with_year_ago(quarters: DataFrame) -> DataFrame:
    """Each quarter with the figures of the same month a year before, by an equi-join on symbol, year and month. Of
    two quarters that end in one month the later one is the base."""
    keyed = quarters.withColumns({"__y": F.year("period_end"), "__m": F.month("period_end")})
    figures = F.struct(F.col("total_revenue").alias("revenue_ya"), F.col("net_income").alias("net_income_ya"))
    last = keyed.groupBy("symbol", (F.col("__y") + 1).alias("__y"), "__m").agg(F.max_by(figures, "period_end").alias("ago"))
    ago = last.select("symbol", "__y", "__m", "ago.revenue_ya", "ago.net_income_ya")
    return keyed.join(ago, ["symbol", "__y", "__m"], "left").drop("__y", "__m")


def ratios(quarters: DataFrame) -> DataFrame:
    """Margins and growth of every quarter."""
    w = Window.partitionBy("symbol").orderBy("period_end")
    df = with_year_ago(quarters.withColumn("revenue_pq", F.lag("total_revenue").over(w)))
    revenue = F.when(F.col("total_revenue") != 0, F.col("total_revenue"))
    before = F.when(F.col("revenue_ya") != 0, F.col("revenue_ya"))
    margin = F.col("net_income") / revenue * 100
    return df.select(
        "symbol", "period_end", "total_revenue", "net_income", growth(F.col("total_revenue"), F.col("revenue_ya")).alias("revenue_yoy_pct"),
        growth(F.col("total_revenue"), F.col("revenue_pq")).alias("revenue_qoq_pct"), growth(F.col("net_income"),
            F.col("net_income_ya")).alias("net_income_yoy_pct"),
        margin.alias("net_margin_pct"), (F.col("operating_income") / revenue * 100).alias("op_margin_pct"),
            (margin - F.col("net_income_ya") / before * 100).alias("net_margin_change_pp"),
    )


def fundamental(quarters: DataFrame) -> DataFrame:
    """The latest quarter of each symbol that has two or more, with its dials."""
    back = Window.partitionBy("symbol").orderBy(F.desc("period_end"))
    latest = ratios(quarters).withColumns({"n": F.row_number().over(back),
        "k": F.count(F.lit(1)).over(Window.partitionBy("symbol"))}).where("n = 1 and k >= 2")
    return latest.drop("n", "k", "total_revenue", "net_income").withColumns(
        {"revenue_growth": growth_bucket(F.col("revenue_yoy_pct")), "earnings_growth": growth_bucket(F.col("net_income_yoy_pct")),
            "margin_trend": margin_trend(F.col("net_margin_change_pp"))}
    )


def quarterly_trend(quarters: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` quarters of each symbol with margins."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))
    margin = F.when(F.col("total_revenue") != 0, F.col("net_income") / F.col("total_revenue") * 100)
    return quarters.withColumn("n", back).where(F.col("n") <= n).select("symbol", "period_end", "total_revenue", "net_income",
        margin.alias("net_margin_pct"))


def features(quarters: DataFrame, lag_days: int = 45) -> DataFrame:
    """``symbol, available, feature, value``: margin and yearly growth at the day they became public, where defined."""
    df = ratios(quarters).where("total_revenue <> 0")
    each = F.explode(F.create_map(F.lit("net_margin"), F.col("net_margin_pct"), F.lit("revenue_yoy"), F.col("revenue_yoy_pct"),
        F.lit("net_income_yoy"), F.col("net_income_yoy_pct"))).alias("feature", "value")
    return df.select("symbol", F.date_add("period_end", lag_days).alias("available"), each).where("value is not null")
