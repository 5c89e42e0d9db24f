"""Data coverage: what each symbol has, and how fresh it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_check(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def coverage_matrix(symbols: DataFrame, prices: DataFrame, quarters: DataFrame, news: DataFrame, chunks: DataFrame,
    owners: DataFrame | None = None) -> DataFrame:
    """Counts and last dates by symbol; what is missing counts 0 and has no date."""
    parts = [
        prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("price_rows"), F.min("date").alias("price_start"), F.max("date").alias("price_end")),
        quarters.groupBy("symbol").agg(F.count(F.lit(1)).alias("quarters"), F.max("period_end").alias("latest_quarter")),
        news.groupBy("symbol").agg(F.count(F.lit(1)).alias("news"), F.max("published").alias("latest_news")),
        chunks.groupBy("symbol").agg(F.countDistinct("source").alias("doc_sources"), F.count(F.lit(1)).alias("doc_chunks"),
            F.max("period").alias("latest_doc_period")),
    ]
    if owners is not None:
        parts.append(owners.groupBy("symbol").agg(F.max("snapshot_at").alias("ownership_at")))
    out = symbols.select("symbol")
    for p in parts:
        out = out.join(p, "symbol", "left")
    return out.fillna(0, ["price_rows", "quarters", "news", "doc_sources", "doc_chunks"])


def matching(matrix: DataFrame, search: str) -> DataFrame:
    """Rows whose symbol holds ``search``, in any case."""
    return matrix.where(F.contains(F.lower("symbol"), F.lit(search.lower())))


def coverage_flag(expected: Column, latest: Column, has_docs: Column) -> Column:
    return F.when(~has_docs, "MISSING").when(expected.isNull(), "UNCHECKED").when(latest.isNull(), "UNTAGGED").when(latest < expected,
        "STALE").otherwise("OK")


def transcript_coverage(symbols: DataFrame, quarters: DataFrame, chunks: DataFrame) -> DataFrame:
    q = quarters.groupBy("symbol").agg(F.max("period_end").alias("expected"))
    d = chunks.groupBy("symbol").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("docs"),
        F.max("period").alias("latest_period"))
    out = symbols.select("symbol").join(q, "symbol", "left").join(d, "symbol", "left").fillna(0, ["chunks", "docs"])
    return out.withColumn("flag", coverage_flag(F.col("expected"), F.col("latest_period"), F.col("chunks") > 0))


def list_documents(chunks: DataFrame) -> DataFrame:
    """Sources of each symbol, latest filing first; the vectors aren't read."""
    out = chunks.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("chunks"), F.max("period").alias("period"),
        F.max("filing_date").alias("filing_date"))
    return out.orderBy("symbol", F.desc_nulls_last("filing_date"), "source")


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_line(df: DataFrame, column: str) -> DataFrame:
    """One row ``line``: counts such as ``2 uptrend · 1 downtrend``, the largest first."""
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label"))),
        lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), x["label"]))
    return label_counts(df, column).agg(F.concat_ws(" · ", each).alias("line"))
