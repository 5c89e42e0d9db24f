"""The back-test's one pass over bars: what it shuffles, ranks of ties and tails, and the recursion by windows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate

DAY = dt.date(2020, 1, 1)


def shuffled_rows(spark) -> int:
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def bars(spark, names=12, days=300):
    rng = np.random.default_rng(7)
    x = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (names, days)), axis=1))
    rows = [(f"N{i:02d}", DAY + dt.timedelta(j), float(x[i, j])) for i in range(names) for j in range(days)]
    return spark.createDataFrame(rows, "symbol string, date date, adj_close double")


def test_bars_are_dealt_by_date_once(spark, tmp_path):
    """Each bar is dealt by symbol and by date, with all its signals; its thinned observations for the two ranks."""
    bars(spark).write.parquet(str(tmp_path / "prices"))
    prices = spark.read.parquet(str(tmp_path / "prices"))
    n = prices.count()
    quarters = prices.groupBy("symbol", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("period_end")).agg(
        F.sum("adj_close").alias("total_revenue"), F.sum("adj_close").alias("operating_income"), F.avg("adj_close").alias("net_income"))
    quarters.write.parquet(str(tmp_path / "quarters"))
    quarters = spark.read.parquet(str(tmp_path / "quarters"))
    before = shuffled_rows(spark)
    rows = evaluate.evaluate(prices, quarters, 5).collect()
    moved = shuffled_rows(spark) - before
    assert {r.signal for r in rows} >= {"rsi", "momentum_3m", "sma50_ratio", "low_vol", "net_margin"}
    assert moved < 8 * n, (moved, n)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_pooled_ranks_with_ties_and_many_values(spark, share):
    """More values than cuts, and a value with a half of all rows or all of them."""
    rng = np.random.default_rng(5)
    n = 4000
    sig, fwd = rng.normal(size=n), rng.normal(size=n).round(2)
    sig[: int(share * n)] = 0.25
    rows = [("s", f"N{i % 50:02d}", DAY + dt.timedelta(i // 50), float(a), float(b)) for i, (a, b) in enumerate(zip(sig, fwd))]
    long = spark.createDataFrame(rows, "signal string, symbol string, date date, sig double, fwd double")
    got = evaluate.pooled(long, 1).first()
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = None if share == 1 else pytest.approx(np.corrcoef(rank(sig), rank(fwd))[0, 1])
    assert got.pooled_ic == want
    assert got.hit == pytest.approx(((sig > np.median(sig)) == (fwd > np.median(fwd))).mean()) and got.base == pytest.approx((fwd > 0).mean())


def test_recursion_by_windows(spark):
    """Over four blocks of 217 rows, one of them without any x: what came before is not lost."""
    from tidemark.functions.scan import ewm_along

    x = np.abs(np.random.default_rng(2).normal(size=800))
    x[3:600] = 0
    rows = spark.createDataFrame([(k, i, float(v)) for k, m in (("a", 800), ("b", 30)) for i, v in enumerate(x[:m])], "k string, i int, x double")
    got = {(r.k, r.i): r.y for r in ewm_along(rows, "k", "i", {"y": F.col("x")}, 0.9).collect()}
    y = x[0]
    for i, v in enumerate(x):
        y = v if i == 0 else (1 - 0.9) * y + 0.9 * v
        assert got["a", i] == pytest.approx(y, rel=1e-9) and (i >= 30 or got["b", i] == got["a", i]), i
        assert got["a", i] > 0 or y < 1e-300, i
