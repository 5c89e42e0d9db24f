"""Equity-shaped tables derived from the bundled test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("symbol", F.to_date("l_shipdate").alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), (F.sum(paid) / F.sum("l_quantity")).alias("adj_close"),
            F.sum("l_quantity").cast("long").alias("volume")
    )


def prices(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    """Daily bars by supplier; with ``by_symbol`` rows are dealt by symbol, once for the bars and all windows of a symbol."""
    rows = table(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_suppkey").cast("string"))
    return _bars(rows.repartition("symbol") if by_symbol else rows)


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by region: dense enough for a common sample."""
    where = _located(spark, sf_dir).select("s_suppkey", F.col("r_name").alias("symbol"))
    items = table(spark, sf_dir, "lineitem")
    return _bars(items.join(where, items.l_suppkey == where.s_suppkey))


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "lineitem").withColumn("symbol", F.lit("MARKET")))


def positions(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Regions held: quantity from positive balances, cost from the first close of ``bars``."""
    quantity = _located(spark, sf_dir).where("s_acctbal > 0").groupBy(F.col("r_name").alias("symbol")).agg(F.sum("s_acctbal").alias("quantity"))
    cost = (region_prices(spark, sf_dir) if bars is None else bars).groupBy("symbol").agg(F.min_by("close", "date").alias("avg_cost"))
    return quantity.join(cost, "symbol")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("sector"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers held, by positive balance."""
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"),
        F.col("s_acctbal").alias("quantity"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by supplier."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = items.join(part.select("p_partkey", "p_retailprice"), items.l_partkey == part.p_partkey)
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
    return rows.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), end.alias("period_end")).agg(
        revenue.alias("total_revenue"), (revenue - F.sum(F.col("l_extendedprice") * 0.7)).alias("operating_income"),
        (revenue - F.sum(F.col("l_quantity") * F.col("p_retailprice") * 0.9)).alias("net_income"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as dated news of ten names."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return d.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 10).cast("string")).alias("symbol"), "doc_id", F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("publisher"), F.when(F.col("doc_id") % 17 != 0, day).alias("published"), F.col("text"),
    )


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price cells seen anew on later days."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"),
            (F.length("event_type") % 5).cast("int")).alias("date"),
        F.to_date("ts").alias("vintage_date"), F.col("value").alias("close"), "event_id",
    )
