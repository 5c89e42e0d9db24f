"""Covariances in tiles, products with vectors, and equal risk, against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import risk, sizing, tiles


def panel(spark, m):
    """A common sample of names S000, S001, ... over days that cross a year."""
    day = lambda i: dt.date(2020, 6, 1) + dt.timedelta(days=2 * i)
    return spark.createDataFrame([(f"S{j:03}", day(i), float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1])],
        "symbol string, date date, x double")


def dense(rows, n, value="cov"):
    out = np.full((n, n), np.nan)
    for r in rows.collect():
        out[int(r.a[1:]), int(r.b[1:])] = r[value]
    return out


def ewma(m, lam):
    w = lam ** np.arange(len(m) - 1, -1, -1)
    w = w / w.sum()
    z = m - w @ m
    return (z * w[:, None]).T @ z


def intensity(m, cov):
    n, sd = len(cov), np.sqrt(np.diag(cov))
    off = ~np.eye(n, dtype=bool)
    rbar = (cov / np.outer(sd, sd))[off].mean()
    target = np.where(off, rbar * np.outer(sd, sd), cov)
    f = m - m.mean(axis=0)
    pi = ((f[:, :, None] * f[:, None, :] - cov) ** 2).mean(axis=0)
    gamma = ((target - cov) ** 2).sum()
    return rbar, gamma, pi.sum(), np.trace(pi), min(1, max(0, (pi.sum() - np.trace(pi)) / gamma / len(m))), target


@pytest.mark.parametrize("n_tiles", [1, 4, None])
def test_tiles_equal_the_whole_matrix(spark, n_tiles, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_NAMES", 5)
    m = np.random.default_rng(1).normal(0, 0.01, (140, 13)) @ (np.eye(13) + 0.2)
    cov = tiles.covariance_tiles(panel(spark, m), n_tiles=n_tiles)
    assert cov.count() == {1: 1, 4: 10, None: 6}[n_tiles]
    want = ewma(m, 0.94)
    assert np.allclose(dense(tiles.entries(cov), 13), want, rtol=1e-10, atol=0)
    sd = np.sqrt(np.diag(want))
    assert np.allclose(dense(tiles.correlation(cov), 13, "rho"), want / np.outer(sd, sd))
    *figures, target = intensity(m, want)
    assert tuple(tiles.shrinkage(cov).first()) == pytest.approx(tuple(figures), rel=1e-8)
    mixed = figures[-1] * target + (1 - figures[-1]) * want
    less = tiles.shrunk(cov)
    assert np.allclose(dense(tiles.entries(less), 13), mixed)
    assert {r.symbol: r["var"] for r in tiles.variances(less).collect()} == pytest.approx({f"S{i:03}": mixed[i, i] for i in range(13)})
    held = {f"S{i:03}": 0.05 * i for i in range(9)}
    w = np.array([held.get(f"S{i:03}", 0.0) for i in range(13)])
    book = spark.createDataFrame([*held.items(), ("other", 5.0), ("S012", None)], "symbol string, weight double")
    got = {r.symbol: r.y for r in tiles.product(less, book).collect()}
    assert got == pytest.approx({f"S{i:03}": (mixed @ w)[i] for i in range(13)})
    shares = {r.symbol: r for r in tiles.risk_contribution(less, book.where("symbol <> 'other' and weight is not null")).collect()}
    assert sum(r.risk_contribution_pct for r in shares.values()) == pytest.approx(100)
    assert shares["S004"].risk_contribution_pct == pytest.approx(100 * w[4] * (mixed @ w)[4] / (w @ mixed @ w))
    assert shares["S004"].portfolio_vol_pct == pytest.approx(100 * np.sqrt(252 * w @ mixed @ w))


def test_tiles_of_odd_samples(spark):
    none = tiles.covariance_tiles(panel(spark, np.zeros((2, 2))).limit(0))
    assert none.count() == 0 and tiles.entries(none).count() == 0
    m = np.random.default_rng(2).normal(size=(30, 3))
    m[:, 1] = 0
    cov = tiles.covariance_tiles(panel(spark, m), 1.0)
    rho = dense(tiles.correlation(cov).where("rho is not null"), 3, "rho")
    assert np.isnan(rho[1]).all() and rho[0, 0] == pytest.approx(1)
    assert 0 <= tiles.shrinkage(cov).first().delta <= 1
    one = tiles.covariance_tiles(panel(spark, m[:, :1]))
    assert tiles.shrinkage(one).first().delta == 0
    with pytest.raises(Exception, match="common sample"):
        tiles.covariance_tiles(panel(spark, m).where("symbol <> 'S001' or date > '2020-06-20'")).count()


def test_what_is_dealt_grows_with_tiles(spark):
    """Rows that meet are pairs of tiles and years, not pairs of names and dates."""
    m = np.random.default_rng(3).normal(size=(60, 40))
    cov = tiles.covariance_tiles(panel(spark, m), n_tiles=4)
    assert cov.count() == 10 and sum(len(r.a) for r in cov.where("i = j").collect()) == 40


def shares_of(w, cov):
    return w * (cov @ w) / (w @ cov @ w)


@pytest.mark.parametrize("n, n_tiles", [(2, 1), (30, 3)])
def test_equal_risk(spark, n, n_tiles):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, n)) * np.linspace(0.2, 3, n) + 0.3 * rng.normal(size=(90, 1))
    cov = tiles.covariance_tiles(panel(spark, m), 1.0, n_tiles)
    less = tiles.shrunk(cov)
    whole = dense(tiles.entries(less), n)
    targets = sizing.equal_risk_weights(less)
    got = {r.symbol: r.target for r in targets.collect()}
    w = np.array([got[f"S{i:03}"] for i in range(n)])
    assert w.sum() == pytest.approx(1) and (w > 0).all() and np.allclose(shares_of(w, whole), 1 / n, rtol=1e-6)
    held = np.linspace(1, 5, n) / np.linspace(1, 5, n).sum()
    book = spark.createDataFrame([(f"S{i:03}", float(v)) for i, v in enumerate(held)], "symbol string, weight double")
    out = sizing.rebalance(less, targets, book, 1000.0).first()
    assert out.turnover == pytest.approx(np.abs(held - w).sum()) and out.cost == pytest.approx(out.turnover * 1.5)
    fall = 100 * (shares_of(held, whole).max() - 1 / n)
    assert out.risk_fall_pp == pytest.approx(fall, rel=1e-5) and out.verdict == ("worth it" if fall >= 10 else "marginal" if fall >= 4 else "skip")
    assert out.scale_to_limit == pytest.approx(min(1, 25 / out.vol_pct))


def test_month_ends(spark):
    rows = [("A", "2020-01-05", 1.0), ("A", "2020-01-09", 2.0), ("A", "2020-03-02", 3.0), ("B", "2020-02-01", 5.0), ("B", "2020-02-09", None)]
    p = spark.createDataFrame(rows, "symbol string, date string, adj_close double").withColumn("date", F.to_date("date"))
    got = [(r.symbol, str(r.date), r.adj_close) for r in risk.month_ends(p).orderBy("symbol", "date").collect()]
    assert got == [("A", "2020-01-01", 2.0), ("A", "2020-02-01", 2.0), ("A", "2020-03-01", 3.0), ("B", "2020-02-01", 5.0), ("B", "2020-03-01", 5.0)]
