"""Portfolio risk on long panels, by aggregates; covariances are in :mod:`tidemark.operators.tiles`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import compounded
from tidemark.lineage import cut

LAMBDA = 0.94
YEAR_DAYS = 252
PARTICIPATION = 0.20
MIN_BETA_ROWS, MIN_TAIL_ROWS, MIN_FHS_ROWS = 60, 20, 40
STRESS_DAYS = (1, 5, 10, 21)

# Limits of a concentrated long-only book.
LIMITS = {"max_name_weight_pct": 30.0, "max_name_risk_pct": 40.0, "max_annual_vol_pct": 25.0, "max_var99_pct": 4.0,
    "min_effective_holdings": 3.0, "max_days_to_liquidate": 5.0}

# Horizons in trading days, their labels and names.
HORIZON_LABELS = {1: "daily", 5: "weekly", 21: "monthly", 63: "quarterly", 252: "annual"}
HORIZON_DAYS = {
    "d": 1, "1d": 1, "day": 1, "daily": 1, "w": 5, "1w": 5, "week": 5, "weekly": 5, "m": 21, "1m": 21, "month": 21, "monthly": 21,
    "q": 63, "1q": 63, "quarter": 63, "quarterly": 63, "y": 252, "1y": 252, "year": 252, "yearly": 252, "annual": 252, "annualised": 252,
        "annualized": 252,
}


def horizon(token: str | int | None) -> tuple[int, str]:
    """Trading days and label of a horizon such as ``weekly``, ``10`` or ``10d``; annual without one."""
    name = "annual" if token is None else str(token).strip().lower()
    days = HORIZON_DAYS.get(name)
    if days is None:
        count = name.removesuffix("d")
        if not count.isdigit() or int(count) == 0:
            raise ValueError(f"unknown horizon {token!r}: use d, w, m, q, y or a number of days")
        days = int(count)
    return days, HORIZON_LABELS.get(days, f"{days}d")


def returns(prices: DataFrame, gap_fill: str | None = None) -> DataFrame:
    """``symbol, date, log_ret, ret``, null on both sides of a gap in the panel's dates; with ``gap_fill="pad"`` simple
    returns span gaps instead. Prices that aren't positive count as missing."""
    p = prices.withColumn("p", F.when(F.col("adj_close") > 0, F.col("adj_close")))
    days = p.select("date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    w = Window.partitionBy("symbol").orderBy("date")
    seen = p.join(F.broadcast(days), "date").withColumns({"before": F.lag("p").over(w), "day_before": F.lag("day").over(w),
        "padded": F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    next_to = F.col("day_before") == F.col("day") - 1
    base = F.col("padded") if gap_fill == "pad" else F.when(next_to, F.col("before"))
    return seen.select("symbol", "date", F.when(next_to, F.ln("p") - F.ln("before")).alias("log_ret"), (F.try_divide("p", base) - 1).alias("ret"))


def month_ends(prices: DataFrame) -> DataFrame:
    """``symbol, date, adj_close``: each month's last close, carried over months without one; ``date`` is the month's
    first day. Months run from a symbol's first one to the panel's last one."""
    month = F.trunc("date", "month")
    ends = prices.where("adj_close is not null").groupBy("symbol", month.alias("date")).agg(F.max_by("adj_close", F.col("date")).alias("c"))
    last = ends.agg(F.max("date").alias("last"))  # a single row
    every = ends.groupBy("symbol").agg(F.min("date").alias("first")).crossJoin(F.broadcast(last)).select("symbol", F.explode(F.sequence("first",
        "last", F.expr("interval 1 month"))).alias("date"))
    carried = F.last("c", True).over(Window.partitionBy("symbol").orderBy("date"))
    return every.join(ends, ["symbol", "date"], "left").select("symbol", "date", carried.alias("adj_close"))


def common_sample(rets: DataFrame, column: str = "log_ret") -> DataFrame:
    """Rows of the dates on which every symbol has a return."""
    there = rets.where(F.col(column).isNotNull())
    n = there.agg(F.countDistinct("symbol").alias("n"))
    full = there.groupBy("date").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("date")
    return cut(there.join(full, "date", "left_semi").select("symbol", "date", F.col(column).alias("x")))  # read by every measure of the book


def ewma_weights(sample: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """``date, w``: lam^(T-1-i), summing to one."""
    back = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))) - 1
    raw = sample.select("date").distinct().withColumn("raw", F.pow(F.lit(lam), back))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("date", (F.col("raw") / F.col("total")).alias("w"))


def betas(rets: DataFrame, bench: DataFrame, min_rows: int = MIN_BETA_ROWS) -> DataFrame:
    """Adjusted betas, 0.67 raw + 0.33, from ``min_rows`` common days on."""
    both = rets.where("ret is not null").select("symbol", "date", "ret").join(bench.where("ret is not null").select("date",
        F.col("ret").alias("m")), "date")
    out = both.groupBy("symbol").agg(F.regr_slope("ret", "m").alias("raw"), F.count(F.lit(1)).alias("n"), F.var_samp("m").alias("v"))
    return out.select("symbol", F.when((F.col("n") >= min_rows) & (F.col("v") > 0), F.col("raw") * 0.67 + 0.33).alias("beta"))


def portfolio_beta(beta: DataFrame, weighted: DataFrame) -> DataFrame:
    """One row ``beta``: weighted betas of the names that have one, their weights as they are; null without any."""
    return beta.where("beta is not null").join(weighted.select("symbol", "weight"),
        "symbol").agg(F.sum(F.col("weight") * F.col("beta")).alias("beta"))


def by_risk(contributions: DataFrame) -> DataFrame:
    """Positions by risk contribution, largest first, those without one last."""
    return contributions.orderBy(F.desc_nulls_last("risk_contribution_pct"), "symbol")


def at_horizon(daily: Column, days: int) -> Column:
    """A daily volatility, VaR or CVaR over ``days`` trading days, by the square root of time."""
    return daily * math.sqrt(days)


def unrealised_pct(last_close: Column, avg_cost: Column) -> Column:
    """Gain on a position's cost in percent; null without a price or a cost."""
    return F.when((last_close != 0) & (avg_cost != 0), (last_close / avg_cost - 1) * 100)


def portfolio_returns(rets: DataFrame, weighted: DataFrame) -> DataFrame:
    sample = common_sample(rets.join(weighted.select("symbol"), "symbol", "left_semi"), "ret")
    return sample.join(weighted.select("symbol", "weight"), "symbol").groupBy("date").agg(F.sum(F.col("weight") * F.col("x")).alias("ret"))


def var_cvar(series: DataFrame, confidence: float, column: str = "ret", least: int = MIN_TAIL_ROWS, keys: list[str] | None = None) -> DataFrame:
    """``var, cvar`` of each key: minus the interpolated quantile, and minus the mean of what lies at or below it."""
    keys = keys or []
    x = series.where(F.col(column).isNotNull())
    q = x.groupBy(*keys).agg(F.percentile(column, 1 - confidence).alias("q"), F.count(F.lit(1)).alias("n"))
    joined = x.join(q, keys) if keys else x.crossJoin(F.broadcast(q))  # without keys q is a single row
    return joined.groupBy(*keys).agg(
        F.when(F.max("n") >= least, -F.max("q")).alias("var"), F.when(F.max("n") >= least,
            -F.avg(F.when(F.col(column) <= F.col("q"), F.col(column)))).alias("cvar")
    )


def fhs(sigmas: DataFrame) -> DataFrame:
    """Returns of a series rescaled from their own volatility to the last one; null where that is zero."""
    last = sigmas.groupBy("key").agg(F.max_by("sigma", "date").alias("now"))
    z = F.try_divide("ret", "sigma") * F.col("now")
    return sigmas.join(last, "key").select("key", "date", F.when(F.col("now") > 0, z).alias("ret"))


def worst_windows(series: DataFrame, days: tuple[int, ...] = STRESS_DAYS) -> DataFrame:
    """``days, worst``: lowest compounded return over full windows of each length."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    each = [compounded(F.col("ret"), n, w).alias(f"w{n}") for n in days]
    low = series.select(*each).agg(*[F.min(f"w{n}").alias(f"w{n}") for n in days])
    return low.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, days)), F.array(*[F.col(f"w{n}") for n in days]))).alias("days", "worst"))


def liquidity(weighted: DataFrame, prices: DataFrame, days: int = 20) -> DataFrame:
    """``symbol, median_traded, days_to_liquidate`` from the median value traded on the last ``days`` days."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    traded = prices.where("close is not null and volume is not null").withColumn("n", back).where(F.col("n") <= days)
    mid = traded.groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("median_traded"))
    dtl = F.when(F.col("median_traded") > 0, F.col("market_value") / (PARTICIPATION * F.col("median_traded")))
    return weighted.join(mid, "symbol", "left").select("symbol", "median_traded", dtl.alias("days_to_liquidate"))


def effective_number(weighted: DataFrame) -> DataFrame:
    return weighted.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.try_divide(F.lit(1.0),
        F.sum(F.col("weight") * F.col("weight"))).alias("effective_holdings"))


def limit_checks(contributions: DataFrame, var99: DataFrame, effective: DataFrame, liquid: DataFrame) -> DataFrame:
    """``metric, value, limit, ok, note``; measures without a value are left out."""
    by = contributions.agg(
        F.max("weight_pct").alias("w"), F.max_by("symbol", "weight_pct").alias("ws"), F.max("risk_contribution_pct").alias("r"),
            F.max_by("symbol", "risk_contribution_pct").alias("rs"), F.max("portfolio_vol_pct").alias("vol")
    )
    one = by.crossJoin(var99.select(F.col("var").alias("v99"))).crossJoin(effective.select("effective_holdings")).crossJoin(liquid.agg(F.max("days_to_liquidate").alias("dtl")))

    def check(metric: str, value: Column, key: str, note: Column, at_least: bool = False) -> Column:
        limit = F.lit(LIMITS[key])
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), limit.alias("limit"),
            (value >= limit if at_least else value <= limit).alias("ok"), note.alias("note"))

    none = F.lit("")
    checks = F.array(
        check("max single-name weight %", F.col("w"), "max_name_weight_pct", F.col("ws")), check("max single-name risk %", F.col("r"),
            "max_name_risk_pct", F.col("rs")),
        check("annualised vol %", F.col("vol"), "max_annual_vol_pct", none), check("1-day 99% VaR %", F.col("v99") * 100, "max_var99_pct", none),
        check("effective holdings", F.col("effective_holdings"), "min_effective_holdings", none, True), check("max days-to-liquidate",
            F.col("dtl"), "max_days_to_liquidate", none),
    )
    return one.select(F.inline(F.filter(checks, lambda c: c["value"].isNotNull())))


def data_warnings(n_var: Column, n_cov: Column) -> Column:
    return F.filter(F.array(F.when(n_var < 252, F.format_string("only %d observations for VaR", n_var)), F.when(n_cov < 60,
        F.format_string("only %d observations for covariance", n_cov))), lambda x: x.isNotNull())
