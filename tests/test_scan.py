"""Recursions by prefix scans and as-of joins by buckets of time, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ewm import ewma_vol_series, rsi_series
from tidemark.functions.scan import doublings, ewm, in_blocks, previous
from tidemark.operators.pit import as_of_join

DAY = dt.date(2020, 1, 1)


def walk(rng, n, key, step=1):
    return [(key, DAY + dt.timedelta(days=step * i + rng.randrange(step)), 100 + rng.uniform(-5, 5)) for i in range(n)]


@pytest.mark.parametrize("alpha", [0.06, 1 / 14, 0.5, 1.0])
def test_ewm_equals_a_loop(spark, alpha):
    rng = random.Random(1)
    rows = walk(rng, 900, "a") + walk(rng, 40, "b", 90) + walk(rng, 1, "c")
    df = spark.createDataFrame(rows, "symbol string, date date, x double").repartition(7)
    for block in (None, F.trunc("date", "month"), F.trunc("date", "year") if alpha == 0.5 else F.lit(1), F.col("date")):
        blocks = in_blocks(df, ["symbol"], "date", block)
        out = {(r.symbol, r.date): (r.y, r.z) for r in ewm(blocks, ["symbol"], {"y": F.col("x"), "z": -2 * F.col("x")}, alpha).collect()}
        last = {}
        for s, day, x in sorted(rows):
            last[s] = (1 - alpha) * last[s] + alpha * x if s in last else x
            assert out[s, day][0] == pytest.approx(last[s], rel=1e-12) and out[s, day][1] == pytest.approx(-2 * last[s], rel=1e-12)
        assert len(out) == len(rows)
    assert 0.94 ** (2 ** doublings(0.94)) == 0 < 0.94 ** (2 ** (doublings(0.94) - 1))


def test_a_block_too_long_is_refused(spark):
    df = spark.range(3000).select(F.lit("a").alias("symbol"), F.col("id").alias("at"), F.lit(1.0).alias("x"))
    with pytest.raises(Exception, match="rows in a block"):
        ewm(in_blocks(df, ["symbol"], "at", F.lit(0)), ["symbol"], {"y": F.col("x")}, 0.5).collect()
    got = ewm(in_blocks(df, ["symbol"], "at", F.floor(F.col("at") / 100)), ["symbol"], {"y": F.col("x")}, 0.5).agg(F.min("y"), F.max("y")).first()
    assert tuple(got) == (1.0, 1.0)


def test_previous_rows_over_blocks(spark):
    rows = walk(random.Random(2), 300, "a") + walk(random.Random(3), 5, "b", 200)
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    got = {(r.symbol, r.date): r.before for r in previous(in_blocks(df, ["symbol"], "date"), ["symbol"], "x", "before").collect()}
    last = {}
    for s, day, x in sorted(rows):
        assert got[s, day] == last.get(s)
        last[s] = x


def test_series_equal_loops(spark):
    rng = random.Random(4)
    rows = walk(rng, 400, "a") + walk(rng, 3, "b") + [("c", DAY, 5.0), ("d", DAY, None), ("e", DAY, 1.0), ("e", DAY + dt.timedelta(1), 2.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r.symbol, r.date): r.rsi for r in rsi_series(df).collect()}
    assert len(got) == len(rows) - 1
    before, up, down = {}, {}, {}
    for s, day, x in sorted(r for r in rows if r[2] is not None):
        if s not in before:
            assert got[s, day] is None
        else:
            d = x - before[s]
            for held, part in ((up, max(d, 0)), (down, max(-d, 0))):
                held[s] = held[s] * 13 / 14 + part / 14 if s in held else part
            want = 100 - 100 / (1 + up[s] / down[s]) if down[s] else None
            assert got[s, day] == (pytest.approx(want, rel=1e-10) if want is not None else None)
        before[s] = x
    rets = [("k", d, x / 100 - 1) for _, d, x in walk(rng, 500, "k")] + [("one", DAY, 0.5), ("k", DAY - dt.timedelta(1), None)]
    vols = {(r.key, r.date): r.sigma for r in ewma_vol_series(spark.createDataFrame(rets, "key string, date date, ret double")).collect()}
    own = [r for r in rets if r[0] == "k" and r[2] is not None]
    mean, v = sum(r[2] for r in own) / len(own), None
    for _, day, x in sorted(own):
        e = (x - mean) ** 2
        v = e if v is None else 0.94 * v + 0.06 * e
        assert vols["k", day] == pytest.approx(v**0.5, rel=1e-10)
    assert vols["one", DAY] == 0 and len(vols) == len(own) + 1


def test_as_of_join_of_a_hot_symbol(spark):
    """Half of all rows under one symbol: each task holds a bucket of time of it, and several values go in one pass."""
    rng = random.Random(5)
    day = lambda n: DAY + dt.timedelta(days=n)
    left = [("hot", day(rng.randrange(2000)), i) for i in range(1500)] + [(f"s{i % 40}", day(rng.randrange(2000)), i) for i in range(1500)]
    left += [(None, day(3), -1), ("hot", None, -2)]
    right = [(s, day(n), rng.choice([None, rng.random()]), rng.choice([None, f"v{n}"])) for s in ["hot", *(f"s{i}" for i in range(0, 40,
        2))] for n in sorted(rng.sample(range(-100, 2100), 60))]
    right += [(None, day(0), 1.0, "x"), ("hot", None, 2.0, "y")]
    a = spark.createDataFrame(left, "symbol string, date date, n int").repartition(5)
    b = spark.createDataFrame(right, "symbol string, at date, v double, w string")
    joined = as_of_join(a, b, "symbol", "date", "at", ["v", "w"])
    assert joined.columns == ["symbol", "date", "n", "v", "w"]

    def known(s, d, place):
        seen = [r for r in right if r[0] is not None and r[1] is not None and r[0] == s and d is not None and r[1] <= d and r[place] is not None]
        return max(seen, key=lambda r: r[1])[place] if seen else None

    rows = joined.collect()
    assert len(rows) == len(left) and all((r.v, r.w) == (known(r.symbol, r.date, 2), known(r.symbol, r.date, 3)) for r in rows)
    one = as_of_join(a, b, "symbol", "date", "at", "v", F.trunc("__at", "year"))
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.drop("w").collect()))
    hot = a.where("symbol = 'hot'")
    spread = as_of_join(hot, b, "symbol", "date", "at", "v").repartition(1).collect()
    most = a.where("symbol = 'hot' and date is not null").groupBy(F.trunc("date", "quarter")).count().agg(F.max("count")).first()[0]
    assert len(spread) == 1501 and most < 150  # rows of the largest bucket
    assert as_of_join(a.limit(0), b, "symbol", "date", "at", "v").count() == 0
