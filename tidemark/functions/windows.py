"""Window expressions over a symbol's own rows. Offsets count trading rows, not calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.lineage import cut


def rows_of(key: str | list[str] = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def lag_return(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def lead_return(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(x, n).over(w), x) - 1


def full_frame(value: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """``value`` over the last n rows, null until n rows with ``x`` are there."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, value.over(frame))


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    return full_frame(F.avg(x), x, n, w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    return full_frame(F.stddev_samp(x), x, n, w)


def compounded(r: Column, n: int, w: WindowSpec) -> Column:
    """Compounded return of the last n rows, full windows only: a product, so that a loss of all is a loss of all."""
    return full_frame(F.product(1 + r), r, n, w) - 1


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank within ``keys`` where ties share the mean of their ranks; one sort gives both."""
    w = Window.partitionBy(*keys).orderBy(x)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w).cast("double") + (ties.cast("double") - 1) / 2


def value_ranks(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys, column, k, before``: for each value how many rows of its key have it, and how many have a smaller one.

    Equal values are counted up first. Counts are then dealt by ranges of (keys, value) and kept with the number of
    their range; ranges' sums are added up, and only one range at a time is sorted: no task holds a key's values.
    """
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("k"))
    placed = cut(counts.repartitionByRange(*keys, column).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "part").agg(F.sum("k").alias("rows"))
    starts = sums.select(*keys, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*keys, "part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("smaller", F.coalesce(F.sum("k").over(within), F.lit(0))).join(starts, [*keys, "part"])
    return ranked.select(*keys, column, "k", (F.col("start") + F.col("smaller")).alias("before"))


def places(df: DataFrame, order: list[Column], name: str = "place", keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order`` within ``keys`` (None: over all rows). Rows are made once, dealt by
    ranges of (keys, order) and kept with the number of their range; ranges' counts are added up, and only one range at
    a time is sorted, so no task holds all rows, or all of a key. Rows that tie may come in any order."""
    keys = keys or []
    by = {f"__o{i}": c for i, c in enumerate(order)}
    # Dealing by ranges looks at the rows twice, so they are made before.
    dealt = cut(cut(df).withColumns(by).repartitionByRange(*keys, *by).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*by))
    return dealt.withColumn("__n", within).join(starts, [*keys, "__part"]).withColumn(name, F.col("__start") + F.col("__n")).drop("__part", "__n",
        "__start", *by)


def every_kth(df: DataFrame, order: list[str], k: int, keys: list[str]) -> DataFrame:
    """Rows 0, k, 2k, ... of each of ``keys`` in ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__n", n).where(F.col("__n") % k == 0).drop("__n")
