"""Prefix scans: recursions along a key's rows whose steps are affine maps, without a key's history in one task.

Rows lie in blocks of time. A block's rows compose to one map; the maps of a key's blocks compose to the value before
each block; a block's rows then only need that value. Nothing runs while such a plan is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_quarter(order: str) -> Column:
    """Blocks for daily rows."""
    return F.trunc(F.col(order), "quarter")


def in_blocks(df: DataFrame, keys: list[str], order: str, block: Column | None = None) -> DataFrame:
    """``df`` with ``__b``, the row's block (any expression that grows with ``order``), and ``__i``, its place there."""
    rows = df.withColumn("__b", by_quarter(order) if block is None else block)
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order)) - 1)


def _along(keys: list[str]) -> WindowSpec:
    """A key's blocks in order: a row for each."""
    return Window.partitionBy(*keys).orderBy("__b")


def previous(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` (of :func:`in_blocks`) with the value of the row before as ``name``; null for a key's first row."""
    last = rows.groupBy(*keys, "__b").agg(F.max_by(value, "__i").alias("__last"))
    heads = last.select(*keys, "__b", F.lag("__last").over(_along(keys)).alias("__head"))
    before = F.lag(value).over(Window.partitionBy(*keys, "__b").orderBy("__i"))
    return rows.join(heads, [*keys, "__b"]).withColumn(name, F.when(F.col("__i") == 0, F.col("__head")).otherwise(before)).drop("__head")


def last_before(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, __b, values``: what was last known of each value before each block of ``rows`` (with ``__b`` and a column
    ``__at`` in whose order values follow each other), nulls skipped."""
    ends = rows.groupBy(*keys, "__b").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__at"))).alias(v) for v in values])
    earlier = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "__b", *[F.last(v, ignorenulls=True).over(earlier).alias(v) for v in values])


def doublings(ratio: float) -> int:
    """Steps of doubling after which composed maps have forgotten what came before: ``ratio ** (2 ** steps)`` is zero."""
    steps = 0
    while ratio ** (2**steps) > 0:
        steps += 1
    return steps


def ewm(rows: DataFrame, keys: list[str], values: dict[str, Column], alpha: float) -> DataFrame:
    """``rows`` (of :func:`in_blocks`) with a column for each of ``values``: the recursion
    y = (1 - alpha) * y_before + alpha * x, begun by the key's first x. No x may be null.

    With r = 1 - alpha, within a block y is the running sum of alpha * x / r ** i, times r ** i, plus r ** (i + 1) times
    the value before the block. So a block of n rows is the map A * y + B with A = r ** n. The maps of a key's blocks
    are composed by doubling: after step s a map reaches 2 ** s blocks back, and once A underflows to zero it has
    forgotten all before, however many blocks there are. A task holds a block's rows, or one row for each block of a
    key. A block may have 600 / -log(r) rows (some 9,700 at alpha 0.06); beyond, the query fails: use finer blocks.
    """
    ratio = 1 - alpha
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha {alpha} isn't in (0, 1]")
    if not ratio:
        return rows.withColumns(values)
    most = int(600 / -math.log(ratio))
    at = F.when(F.col("__i") <= most, F.col("__i")).otherwise(F.raise_error(F.lit(f"over {most} rows in a block")).cast("int"))
    rows = rows.withColumns({f"__x_{n}": x for n, x in values.items()}).withColumn("__p", F.pow(F.lit(ratio), at))
    within = Window.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.sum(alpha * F.col(f"__x_{n}") / F.col("__p")).over(within) * F.col("__p") for n in values})
    w = _along(keys)
    maps = local.groupBy(*keys, "__b").agg((F.min("__p") * ratio).alias("__A"), *[F.max_by(n, "__i").alias(f"__B_{n}") for n in values],
        *[F.min_by(f"__x_{n}", "__i").alias(f"__f_{n}") for n in values])
    first = F.row_number().over(w) == 1
    # Before a key's first row stands its first x.
    maps = maps.withColumn("__first", first).select(*keys, "__b", "__first", *[f"__f_{n}" for n in values],
        *[F.when(F.col("__first"), F.col("__A") * F.col(f"__f_{n}") + F.col(f"__B_{n}")).otherwise(F.col(f"__B_{n}")).alias(f"__B_{n}") for n in
            values], F.when(F.col("__first"), 0.0).otherwise(F.col("__A")).alias("__A"))
    kept = [*keys, "__b", "__first", *[f"__f_{n}" for n in values]]
    for step in range(doublings(ratio)):
        maps = maps.select(*kept, *[(F.col("__A") * F.coalesce(F.lag(f"__B_{n}", 2**step).over(w), F.lit(0.0)) + F.col(f"__B_{n}")).alias(
            f"__B_{n}") for n in values], (F.col("__A") * F.coalesce(F.lag("__A", 2**step).over(w), F.lit(0.0))).alias("__A"))
    starts = maps.select(*keys, "__b", *[F.when(F.col("__first"), F.col(f"__f_{n}")).otherwise(F.lag(f"__B_{n}").over(w)).alias(f"__s_{n}") for n in
        values])
    joined = local.join(starts, [*keys, "__b"]).withColumns({n: F.col(n) + F.col("__p") * ratio * F.col(f"__s_{n}") for n in values})
    return joined.drop("__p", *[f"__x_{n}" for n in values], *[f"__s_{n}" for n in values])


def ewm_along(rows: DataFrame, key: str, order: str, values: dict[str, Column], alpha: float) -> DataFrame:
    """:func:`ewm` for rows that windows bring together by ``key`` anyway: more windows, and no shuffle or join.

    Blocks are as long as the powers of r allow, some 500 / -log(r) rows (6,700 at alpha 1 / 14). Two of them multiply to
    zero in doubles, so what lies before a block comes from the two blocks before it and, there, from the first x.
    """
    ratio = 1 - alpha
    length = int(500 / -math.log(ratio))
    w = Window.partitionBy(key).orderBy(order)
    at = F.row_number().over(w) - 1
    rows = rows.withColumns({f"__x_{n}": x for n, x in values.items()} | {"__at": at})
    rows = rows.withColumns({f"__f_{n}": F.first(f"__x_{n}").over(w) for n in values})
    rows = rows.withColumns({"__b": F.floor(F.col("__at") / length), "__i": F.col("__at") % length}).withColumn("__p", F.pow(F.lit(ratio), F.col("__i")))
    within = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(alpha * F.col(f"__x_{n}") / F.col("__p")).over(within) * F.col("__p") for n in values})
    whole = ratio**length
    back = lambda n, k: F.coalesce(F.max_by(n, "__i").over(Window.partitionBy(key).orderBy("__b").rangeBetween(-k, -k)), F.lit(0.0))
    seed = lambda n: F.when(F.col("__b") < 2, F.pow(F.lit(whole), F.col("__b")) * F.col(f"__f_{n}")).otherwise(0.0)
    rows = rows.withColumns({f"__s_{n}": back(n, 1) + whole * back(n, 2) + seed(n) for n in values})
    rows = rows.withColumns({n: F.col(n) + F.col("__p") * ratio * F.col(f"__s_{n}") for n in values})
    return rows.drop("__at", "__b", "__i", "__p", *[f"__{c}_{n}" for n in values for c in "xfs"])
