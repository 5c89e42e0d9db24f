"""Point-in-time reads: cut-offs, latest versions, bitemporal replay, as-of joins and change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scan import last_before

ANNOUNCEMENT_LAG_DAYS = 45


def as_of_filter(df: DataFrame, column: str, as_of: str | None) -> DataFrame:
    """Rows known by midnight of ``as_of``; rows without a date are unknown then. No cut-off without a date."""
    return df if as_of is None else df.where(F.col(column) <= F.lit(as_of).cast("date"))


def announced(df: DataFrame, as_of: str | None, lag_days: int = ANNOUNCEMENT_LAG_DAYS) -> DataFrame:
    """Quarters whose results were public by ``as_of``; the cut-off folds to a literal and is pushed to the scan."""
    return df if as_of is None else df.where(F.col("period_end") <= F.date_sub(F.lit(as_of).cast("date"), lag_days))


def panel(prices: DataFrame, as_of: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Long price panel with adjusted closes filled from closes."""
    df = as_of_filter(prices, "date", as_of)
    df = df.where(F.col("symbol").isin(symbols)) if symbols else df
    return df.withColumn("adj_close", F.coalesce("adj_close", "close"))


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``, by one aggregate. Rows without an order come before all others; of rows
    that tie one stays, the same on each run."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.isNotNull(), order,
        F.xxhash64(*rest))).alias("__row")).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def known_at(vintages: DataFrame, known: str, as_of: str | None = None, tie: str | None = None) -> DataFrame:
    """The prices that were known on ``known``: of each (symbol, date) its latest vintage by then."""
    seen = as_of_filter(as_of_filter(vintages, "vintage_date", known), "date", as_of)
    order = F.struct("vintage_date", tie) if tie else F.col("vintage_date")
    return latest_by(seen, ["symbol", "date"], order)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: str | list[str],
    bucket: Column | None = None) -> DataFrame:
    """``left`` with what was last known of each of ``values`` at or before its time; nulls of ``right`` tell nothing.

    Both sides lie in buckets of time (quarters of ``__at`` unless an expression that grows with it is given). Each
    bucket gets a row with what was last known before it, so windows run within buckets: a task holds a bucket of a key,
    or a row for each of a key's buckets, and a key with most of all rows is spread out. Of rows of ``right`` with equal
    times any may be the last. Rows of ``left`` without a key or a time get nulls.
    """
    values, cols = [values] if isinstance(values, str) else values, left.columns
    place = F.trunc(F.col("__at").cast("date"), "quarter") if bucket is None else bucket
    none = {f"__v_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}
    marked = left.withColumns({**none, "__at": F.col(left_ts), "__side": F.lit(1)}).withColumn("__b", place)
    feed = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(key),
        *[F.col(v).alias(f"__v_{v}") for v in values], F.col(right_ts).cast(left.schema[left_ts].dataType).alias("__at")).withColumn("__b", place)
    there = marked.where(F.col(key).isNotNull() & F.col("__at").isNotNull())
    both = there.withColumn("__row", F.struct(*cols)).select(key, *none, "__at", "__b", "__side", "__row").unionByName(feed.withColumns({"__side":
        F.lit(0), "__row": F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType)}))
    buckets = feed.unionByName(there.select(key, *none, F.lit(None).cast(left.schema[left_ts].dataType).alias("__at"), "__b").distinct())
    carried = last_before(buckets, [key], list(none)).select("*", F.lit(None).cast(left.schema[left_ts].dataType).alias("__at"),
        F.lit(-1).alias("__side"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__row"))
    w = Window.partitionBy(key, "__b").orderBy(F.asc_nulls_first("__at"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    known = both.unionByName(carried).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in none}).where("__side = 1")
    out = known.select("__row.*", *[F.col(c).alias(c.removeprefix("__v_")) for c in none])
    outside = left.where(F.col(key).isNull() | F.col(left_ts).isNull())
    return out.unionByName(outside.withColumns({v: F.lit(None).cast(right.schema[v].dataType) for v in values}))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Last write wins by ``stamp``."""
    return latest_by(old.unionByName(new), keys, F.col(stamp))


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], exact: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` that are new or restated: a value moved by over 1e-9 of itself, or an ``exact`` one at all."""
    before = old.select(*keys, *[F.col(v).alias(f"__{v}") for v in (*values, *exact)], F.lit(True).alias("__there"))
    moved = F.col("__there").isNull()
    for v in values:
        a, b = F.col(v), F.col(f"__{v}")
        near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-9, F.lit(1e-12))
        moved = moved | ~F.coalesce(near, a.isNull() & b.isNull())
    for v in exact:
        moved = moved | ~F.col(v).eqNullSafe(F.col(f"__{v}"))
    return new.join(before, keys, "left").where(moved).select(*new.columns)


def drawdown(prices: DataFrame) -> DataFrame:
    """Deepest fall from a running peak of each symbol's adjusted close, percent."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return prices.select("symbol", (F.try_divide(F.col("adj_close"),
        F.max("adj_close").over(w)) - 1).alias("dd")).groupBy("symbol").agg((F.min("dd") * 100).alias("max_drawdown_pct"))
