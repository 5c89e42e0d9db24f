"""Covariance of many names: names are cut into tiles, and each pair of tiles is a few matrix products over dates.

What crosses the network is each tile once for each tile, not a row for each pair of names and date; the matrix itself
stays in pieces, and sums and products with vectors are taken piece by piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.operators.risk import LAMBDA, YEAR_DAYS, ewma_weights

#: Names of a tile, about.
TILE_NAMES = 256

PACKED = "tile int, period string, names array<string>, z binary, f binary, t int"
FEW = "i int, j int, a array<string>, b array<string>, cov binary"
TILES = FEW + ", m1 binary, m2 binary, va binary, vb binary, t long"
_FIELDS = [("i", pa.int32()), ("j", pa.int32()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string())), *((k, pa.binary()) for k in ("cov", "m1",
    "m2", "va", "vb")), ("t", pa.int64())]
SMALL, WHOLE = pa.schema(_FIELDS[:5]), pa.schema(_FIELDS)


def tile_of(symbol: Column, n_tiles: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(n_tiles)).cast("int")


def _square(raw: bytes, a: list, b: list) -> np.ndarray:
    return np.frombuffer(raw).reshape(len(a), len(b))


def _packed(sample: DataFrame, lam: float, n_tiles: int) -> DataFrame:
    """A row for each tile and year: its names in order, and their returns, centred by the weighted mean and scaled by
    the root of the dates' weights (``z``) and centred by the plain mean (``f``)."""
    weighted = sample.join(ewma_weights(sample, lam), "date")
    means = weighted.groupBy("symbol").agg(F.sum(F.col("w") * F.col("x")).alias("mu"), F.avg("x").alias("flat"))
    rows = weighted.join(means, "symbol").select(tile_of(F.col("symbol"), n_tiles).alias("tile"), F.date_format("date",
        "yyyy").alias("period"), "symbol", "date", (F.sqrt("w") * (F.col("x") - F.col("mu"))).alias("z"), (F.col("x") - F.col("flat")).alias("f"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["symbol", "date"])
        names, t = pdf["symbol"].unique().tolist(), pdf["date"].nunique()
        if len(pdf) != len(names) * t:
            raise ValueError("a common sample has one return for each name and date")
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1], "period": pdf["period"].iloc[:1], "names": [names], "z": [pdf["z"].to_numpy(
            float).tobytes()], "f": [pdf["f"].to_numpy(float).tobytes()], "t": [t]})

    return rows.groupBy("tile", "period").applyInPandas(pack, PACKED)


def covariance_tiles(sample: DataFrame, lam: float = LAMBDA, n_tiles: int | None = None) -> DataFrame:
    """The weighted covariance of a common sample (``symbol, date, x``) as a table with a row for each pair of tiles
    i <= j: the names, the covariances, the sums of products and of squared products of plainly centred returns, the
    names' variances, and the number of dates. A tile's names are told by a hash; without ``n_tiles`` names are counted."""
    n_tiles = n_tiles or max(1, -(-sample.select("symbol").distinct().count() // TILE_NAMES))
    packed = _packed(sample, lam, n_tiles)
    left = packed.select("period", F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile"), F.lit(n_tiles - 1))).alias("j"),
        F.col("names").alias("a"), F.col("z").alias("za"), F.col("f").alias("fa"), "t")
    right = packed.select("period", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"),
        F.col("names").alias("b"), F.col("z").alias("zb"), F.col("f").alias("fb"))

    def products(batches):
        for batch in batches:
            for r in batch.to_pylist():
                za, fa = (np.frombuffer(r[x]).reshape(len(r["a"]), r["t"]) for x in ("za", "fa"))
                zb, fb = (np.frombuffer(r[x]).reshape(len(r["b"]), r["t"]) for x in ("zb", "fb"))
                made = (za @ zb.T, fa @ fb.T, (fa * fa) @ (fb * fb).T, (za * za).sum(axis=1), (zb * zb).sum(axis=1))
                yield pa.RecordBatch.from_pylist([{"i": r["i"], "j": r["j"], "a": r["a"], "b": r["b"], "t": r["t"],
                    **{k: v.tobytes() for k, v in zip(("cov", "m1", "m2", "va", "vb"), made)}}], WHOLE)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        for c in ("cov", "m1", "m2", "va", "vb"):
            out[c] = [np.sum([np.frombuffer(x) for x in pdf[c]], axis=0).tobytes()]
        return out.assign(t=int(pdf["t"].sum()))

    parts = left.join(right, ["i", "j", "period"]).mapInArrow(products, TILES)
    return cut(parts.groupBy("i", "j").applyInPandas(total, TILES))


def shrinkage(tiles: DataFrame) -> DataFrame:
    """One row ``rbar, gamma, pi, rho, delta``: intensity of the shrink toward constant correlation, from a few sums of
    each tile."""

    def sums(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cov, m1, m2 = (_square(r[x], r["a"], r["b"]) for x in ("cov", "m1", "m2"))
                va, vb = np.frombuffer(r["va"]), np.frombuffer(r["vb"])
                sd, diagonal = np.sqrt(np.outer(va, vb)), r["i"] == r["j"]
                pi = m2 / r["t"] - 2 * cov * m1 / r["t"] + cov * cov
                other = np.ones(cov.shape) - (np.eye(len(cov)) if diagonal else 0)
                twice = 1.0 if diagonal else 2.0
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = np.where(sd > 0, cov / sd, np.nan)
                counted = (other > 0) & ~np.isnan(corr)
                yield pa.RecordBatch.from_pylist([{"names": float(len(cov)) if diagonal else 0.0, "t": float(r["t"]), "pairs": twice * counted.sum(),
                    "corr": twice * corr[counted].sum(), "ss": twice * (other * sd * sd).sum(), "sc": twice * (other * sd * cov).sum(),
                    "cc": twice * (other * cov * cov).sum(), "pi": twice * pi.sum(), "rho": float(np.trace(pi)) if diagonal else 0.0}])

    names = ["names", "t", "pairs", "corr", "ss", "sc", "cc", "pi", "rho"]
    s = tiles.mapInArrow(sums, ", ".join(f"{c} double" for c in names)).agg(*[(F.max if c == "t" else F.sum)(c).alias(c) for c in names])
    rbar = F.try_divide("corr", "pairs")
    gamma = rbar * rbar * F.col("ss") - 2 * rbar * F.col("sc") + F.col("cc")
    s = s.select("names", "t", "pi", "rho", rbar.alias("rbar"), gamma.alias("gamma"))
    raw = (F.col("pi") - F.col("rho")) / F.col("gamma") / F.col("t")
    delta = F.when((F.col("names") < 2) | (F.col("gamma") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return s.select("rbar", "gamma", "pi", "rho", F.coalesce(delta, F.lit(0.0)).alias("delta"))


def shrunk(tiles: DataFrame) -> DataFrame:
    """``i, j, a, b, cov``: the tiles shrunk toward constant correlation."""

    def shrink(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cov, sd = _square(r["cov"], r["a"], r["b"]), np.sqrt(np.outer(np.frombuffer(r["va"]), np.frombuffer(r["vb"])))
                if r["delta"] > 0:
                    target = r["rbar"] * sd
                    if r["i"] == r["j"]:
                        np.fill_diagonal(target, np.diag(cov))
                    cov = r["delta"] * target + (1 - r["delta"]) * cov
                yield pa.RecordBatch.from_pylist([{"i": r["i"], "j": r["j"], "a": r["a"], "b": r["b"], "cov": cov.tobytes()}], SMALL)

    one = shrinkage(tiles).select("rbar", "delta")  # a single row
    return cut(tiles.crossJoin(F.broadcast(one)).mapInArrow(shrink, FEW))


def entries(tiles: DataFrame) -> DataFrame:
    """``a, b, cov``: a row for each ordered pair of names."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cov = _square(r["cov"], r["a"], r["b"])
                a, b = np.array(r["a"], object), np.array(r["b"], object)
                yield pa.record_batch([pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(cov.ravel())], ["a", "b", "cov"])
                if r["i"] != r["j"]:
                    yield pa.record_batch([pa.array(np.repeat(b, len(a))), pa.array(np.tile(a, len(b))), pa.array(cov.T.ravel())], ["a", "b", "cov"])

    return tiles.mapInArrow(rows, "a string, b string, cov double")


def correlation(tiles: DataFrame) -> DataFrame:
    """``a, b, rho`` of :func:`covariance_tiles`; null beside a name that doesn't move."""

    def scale(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sd = np.sqrt(np.outer(np.frombuffer(r["va"]), np.frombuffer(r["vb"])))
                rho = np.divide(_square(r["cov"], r["a"], r["b"]), sd, out=np.full(sd.shape, np.nan), where=sd > 0)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("i", "j", "a", "b")} | {"cov": rho.tobytes()}], SMALL)

    return entries(tiles.mapInArrow(scale, FEW)).select("a", "b", F.when(~F.isnan("cov"), F.col("cov")).alias("rho"))


def variances(tiles: DataFrame) -> DataFrame:
    """``symbol, var`` from the tiles on the diagonal."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.record_batch([pa.array(r["a"], pa.string()), pa.array(np.diag(_square(r["cov"], r["a"], r["b"])).copy())], ["symbol", "var"])

    return tiles.where("i = j").mapInArrow(rows, "symbol string, var double")


def product(tiles: DataFrame, vector: DataFrame, column: str = "weight", n_tiles: int | None = None) -> DataFrame:
    """``symbol, y``: the matrix times a vector (``symbol, column``); names without a value count as zero. The vector
    goes to the tiles as arrays by tile, each tile gives its part of both its sides, and parts are summed by name.
    Without ``n_tiles`` they are counted in the same plan."""
    there = vector.where(F.col(column).isNotNull()).select("symbol", F.col(column).cast("double").alias("x"))
    if n_tiles is None:
        there, n = there.crossJoin(F.broadcast(tiles.agg((F.max("j") + 1).alias("n")))), F.col("n")
    else:
        n = F.lit(n_tiles)
    named = there.select(F.pmod(F.xxhash64("symbol"), n).cast("int").alias("tile"), "symbol", "x")
    arrays = named.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "x"))).alias("x"))
    pick = lambda names, x: F.transform(names, lambda s: F.coalesce(F.try_element_at(x, s), F.lit(0.0)))
    none = F.create_map().cast("map<string,double>")
    at = lambda own: arrays.select(F.col("tile").alias(own), F.col("x").alias(f"x_{own}"))
    both = tiles.join(at("i"), "i", "left").join(at("j"), "j", "left").select("i", "j", "a", "b", "cov", pick(F.col("a"), F.coalesce("x_i",
        none)).alias("xa"), pick(F.col("b"), F.coalesce("x_j", none)).alias("xb"))

    def parts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cov = _square(r["cov"], r["a"], r["b"])
                yield pa.record_batch([pa.array(r["a"], pa.string()), pa.array(cov @ np.array(r["xb"], float))], ["symbol", "y"])
                if r["i"] != r["j"]:
                    yield pa.record_batch([pa.array(r["b"], pa.string()), pa.array(cov.T @ np.array(r["xa"], float))], ["symbol", "y"])

    return both.mapInArrow(parts, "symbol string, y double").groupBy("symbol").agg(F.sum("y").alias("y"))


def risk_contribution(tiles: DataFrame, weighted: DataFrame, days: int = YEAR_DAYS) -> DataFrame:
    """As :func:`tidemark.operators.risk.risk_contribution`, from tiles, for a book of any number of names."""
    w = weighted.select("symbol", "weight")
    one = w.join(product(tiles, w), "symbol").join(variances(tiles), "symbol")
    total = one.agg(F.sum(F.col("weight") * F.col("y")).alias("pvar"))  # a single row
    scale = float(np.sqrt(days))
    return one.crossJoin(F.broadcast(total)).select("symbol", (F.col("weight") * 100).alias("weight_pct"),
        (F.sqrt("var") * scale * 100).alias("vol_pct"), F.try_divide("y", F.sqrt("pvar")).alias("mctr"),
        (F.try_divide(F.col("weight") * F.col("y"), F.col("pvar")) * 100).alias("risk_contribution_pct"),
        (F.sqrt("pvar") * scale * 100).alias("portfolio_vol_pct"))
