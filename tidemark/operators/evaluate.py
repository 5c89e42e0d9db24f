"""Signal evaluation: bars with all signals in columns, one shuffle by date for ranks and one aggregate for the scores."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scan import ewm_along
from tidemark.functions.windows import average_rank, lag_return, lead_return, rolling_mean, rolling_std, rows_of
from tidemark.lineage import cut
from tidemark.operators import pit
from tidemark.operators.fundamental import features
from tidemark.operators.pit import as_of_join

MIN_HISTORY, MIN_NAMES, MIN_DATES = 250, 4, 8
COST_BPS = 15.0
#: Signals on prices; each is an expression over a symbol's own rows. Register more here.
SIGNALS: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "momentum_3m": lambda x, w: lag_return(x, 63, w),
    "sma50_ratio": lambda x, w: F.try_divide(x, rolling_mean(x, 50, w)) - 1,
}


def _enough(prices: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(rows_of().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return prices.where("adj_close is not null").withColumn("rows", n).where(F.col("rows") >= MIN_HISTORY).drop("rows")


def _own(prices: DataFrame) -> DataFrame:
    return _enough(prices.select("symbol", "date", "adj_close"))


def _wide_price_signals(own: DataFrame, horizon: int, signals=None, with_rsi: bool = True) -> tuple[DataFrame, list[str]]:
    """``symbol, date, fwd`` and a column for each price signal, and these columns' names. RSI's moves come from the
    windows that the others use, so bars dealt by symbol stay where they are."""
    w, x = rows_of(), F.col("adj_close")
    chosen = signals or SIGNALS
    names = [*chosen, "low_vol"]
    move = F.coalesce(x - F.lag(x).over(w), F.lead(x).over(w) - x)
    kept = {"r": lag_return(x, 1, w), "fwd": lead_return(x, horizon, w)} | {name: f(x, w) for name, f in chosen.items()}
    wide = own.withColumns(kept | ({"__move": move, "__first": F.lag(x).over(w).isNull()} if with_rsi else {}))
    wide = wide.withColumn("low_vol", -rolling_std(F.col("r"), 63, w))
    if not with_rsi:
        return wide.select("symbol", "date", "fwd", *names), names
    # A symbol's first bar has no move. It takes the second one's, which leaves the recursion from there on as it is.
    of = {"__up": F.greatest("__move", F.lit(0.0)), "__down": F.greatest(-F.col("__move"), F.lit(0.0))}
    both = ewm_along(wide.select("symbol", "date", "fwd", *names, "__move", "__first"), "symbol", "date", of, 1 / 14)
    rsi = F.when(~F.col("__first"), 100 - 100 / (1 + F.col("__up") / F.nullif("__down", F.lit(0.0))))
    return both.select("symbol", "date", "fwd", *names, rsi.alias("rsi")), [*names, "rsi"]


def price_signals(prices: DataFrame, horizon: int, signals=None, with_rsi: bool = True) -> DataFrame:
    """``signal, symbol, date, sig, fwd`` of each price signal and of low volatility; nulls are left out."""
    wide, names = _wide_price_signals(_own(prices), horizon, signals, with_rsi)
    long = wide.unpivot(["symbol", "date", "fwd"], names, "signal", "sig")
    return long.where("sig is not null and fwd is not null").select("signal", "symbol", "date", "sig", "fwd")


FUNDAMENTAL_SIGNALS = ["net_margin", "revenue_yoy", "net_income_yoy"]


def _wide_fundamental_signals(own: DataFrame, quarters: DataFrame, horizon: int, lag_days: int = 45) -> DataFrame:
    """``symbol, date, fwd`` and a column for each fundamental signal, null off its every ``horizon``-th date. A signal
    has the dates from a name's first public value on, so dates are chosen before bars meet quarters, and only bars of
    chosen dates do."""
    names = FUNDAMENTAL_SIGNALS
    bars = own.select("symbol", "date", lead_return(F.col("adj_close"), horizon, rows_of()).alias("fwd")).where("fwd is not null")
    f = features(cut(quarters), lag_days)
    wide = cut(f.groupBy("symbol", "available").agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names]))
    since = wide.groupBy("symbol").agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("available"))).alias(n) for n in names])
    there = bars.join(since, "symbol", "left").groupBy("date").agg(*[F.max(F.coalesce(F.col("date") >= F.col(n), F.lit(False))).alias(n) for n in names])
    place = lambda n: F.when(F.col(n), F.count_if(n).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    at = there.select("date", *[(F.coalesce(place(n) % horizon, F.lit(-1)) == 0).alias(f"__{n}") for n in names])
    at = F.broadcast(at.where(" or ".join(f"__{n}" for n in names)))
    # A symbol told by fwd, too: no condition on it goes below the windows, where it would have bars dealt once more.
    symbol = F.when(F.col("fwd").isNotNull(), F.col("symbol")).alias("symbol")
    known = as_of_join(bars.join(at, "date").select(symbol, "date", "fwd"), wide, "symbol", "date", "available", names)
    return known.join(at, "date").select("symbol", "date", "fwd", *[F.when(F.col(f"__{n}"), F.col(n)).alias(n) for n in names])


def fundamental_signals(prices: DataFrame, quarters: DataFrame, horizon: int, lag_days: int = 45) -> DataFrame:
    """Signals of margin and growth from the day they were public until superseded, on every ``horizon``-th date."""
    wide = _wide_fundamental_signals(_own(prices), quarters, horizon, lag_days)
    long = wide.unpivot(["symbol", "date", "fwd"], FUNDAMENTAL_SIGNALS, "signal", "sig").where("sig is not null")
    return long.select("signal", "symbol", "date", "sig", "fwd")


def _rank_corr() -> Column:
    flat = (F.min("rs") == F.max("rs")) | (F.min("rf") == F.max("rf"))
    return F.when(~flat & (F.count(F.lit(1)) >= 3), F.try_divide(F.covar_pop("rs", "rf"), F.stddev_pop("rs") * F.stddev_pop("rf")))


def by_date(long: DataFrame) -> DataFrame:
    """``signal, date, n, ic, spread`` across the names of each date, by one shuffle: their rank correlation, and the
    mean forward return of the top third less that of the bottom third, ties by symbol. Null with too few names."""
    keys = ["signal", "date"]
    lo = F.row_number().over(Window.partitionBy(*keys).orderBy("sig", "symbol"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = long.withColumns({"lo": lo, "n": n, "rs": average_rank("sig", keys), "rf": average_rank("fwd", keys)})
    third = F.greatest(F.lit(1), F.rint(F.col("n") / 3))
    top, bottom = F.avg(F.when(F.col("lo") > F.col("n") - third, F.col("fwd"))), F.avg(F.when(F.col("lo") <= third, F.col("fwd")))
    enough = F.count(F.lit(1)) >= MIN_NAMES
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(enough, _rank_corr()).alias("ic"), F.when(enough, top - bottom).alias("spread")
    )


def cross_sectional_ic(long: DataFrame) -> DataFrame:
    """``signal, date, ic, n``: rank correlation across names of each date with enough of them."""
    return by_date(long).where("ic is not null").select("signal", "date", "ic", "n")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def newey_west(ics: DataFrame, lag: int, *more: Column) -> DataFrame:
    """``signal, m, mean_ic, ic_std, icir, t``: the mean's t value with Bartlett weights up to ``lag``; and ``more``
    aggregates of the same rows. A signal's series is one row: as long as there are dates."""
    dated = F.when(F.col("ic").isNotNull(), F.struct("date", "ic"))
    series = F.transform(F.sort_array(F.collect_list(dated)), lambda x: x["ic"])
    rows = ics.groupBy("signal").agg(series.alias("x"), *more).withColumn("m", F.size("x")).where("m > 0")
    names = [c for c in rows.columns if c not in ("signal", "x", "m")]
    rows = rows.withColumn("mean_ic", _total(F.col("x")) / F.col("m"))
    rows = rows.withColumn("e", F.transform("x", lambda x: x - F.col("mean_ic"))).withColumn("lags", F.least(F.lit(lag), F.col("m") - 1))
    squares = _total(F.transform("e", lambda x: x * x))

    def at_lag(k: Column) -> Column:
        later, sooner = F.slice("e", k + 1, F.col("m") - k), F.slice("e", F.lit(1), F.col("m") - k)
        return (1 - k / (F.col("lags") + 1)) * _total(F.zip_with(later, sooner, lambda x, y: x * y))

    each = F.when(F.col("lags") >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("lags"), F.lit(1))), at_lag)).otherwise(F.array(F.lit(0.0)))
    rows = rows.withColumns({"squares": squares, "s": (squares + 2 * _total(each)) / F.col("m")})
    std = F.when(F.col("m") >= 2, F.sqrt(F.col("squares") / (F.col("m") - 1)))
    t = F.when((F.col("m") >= MIN_DATES) & (F.col("s") > 0), F.col("mean_ic") / F.sqrt(F.col("s") / F.col("m")))
    rows = rows.withColumns({"ic_std": std, "t": t})
    return rows.select("signal", F.col("m").cast("bigint").alias("m"), "mean_ic", "ic_std", F.try_divide("mean_ic", "ic_std").alias("icir"),
        "t", *names)


def tercile_spread(long: DataFrame) -> DataFrame:
    """``signal, spread``: the mean over dates of :func:`by_date`'s spread."""
    return by_date(long).where("spread is not null").groupBy("signal").agg(F.avg("spread").alias("spread"))


def net_spread(gross: Column, bps: float = COST_BPS) -> Column:
    """Size of the spread less four legs of costs."""
    return F.abs(gross) - 4 * bps / 1e4


def thinned(long: DataFrame, obs_step: int) -> DataFrame:
    """Every ``obs_step``-th observation of each signal in (date, symbol) order. Dates' counts are summed up first, so
    no window holds more than one date's names or one signal's dates."""
    per_date = long.groupBy("signal", "date").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("signal").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_date.select("signal", "date", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("signal", "date").orderBy("symbol")) - 1
    numbered = long.withColumn("n", within).join(starts, ["signal", "date"])
    return numbered.where((F.col("n") + F.col("start")) % obs_step == 0).drop("n", "start")


#: Cuts of each signal's values: their ranks are counted in twice as many cells.
CUTS = 255


def _celled(rows: DataFrame, cuts: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``__cell``, which grows with ``column``: even between two cuts, odd for values equal to a cut."""
    rows = rows.join(F.broadcast(cuts.select("signal", F.col(f"__{column}").alias("__cuts"))), "signal").withColumn("__at", F.lit(0))
    for step in [2**k for k in reversed(range(CUTS.bit_length()))]:
        cut_there = F.get("__cuts", F.col("__at") + step - 1)
        rows = rows.withColumn("__at", F.col("__at") + F.when(cut_there <= F.col(column), step).otherwise(0))
    equal = F.coalesce(F.get("__cuts", F.greatest(F.col("__at") - 1, F.lit(0))) == F.col(column), F.lit(False)) & (F.col("__at") > 0)
    return rows.withColumn("__cell", F.col("__at") * 2 - equal.cast("int")).drop("__at", "__cuts")


def _ranked(rows: DataFrame, cuts: DataFrame, sizes: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the mean rank, from 0, of ``column`` in its signal. A cell between two cuts is sorted by one task. A
    cell of equal values needs no sort, so it is dealt out; any value with a good share of the rows is such a cut."""
    odd = F.col("__cell") % 2 == 1
    rows = _celled(rows, cuts, column).withColumn("__deal", F.when(odd, F.pmod(F.xxhash64(*rows.columns), F.lit(64))).otherwise(0).cast("int"))
    within = rows.withColumn("__within", average_rank(column, ["signal", "__cell", "__deal"]) - 1)
    of = F.broadcast(sizes.where(F.col("which") == column).select("signal", F.col("cell").alias("__cell"), "before", "k"))
    rank = F.col("before") + F.when(odd, (F.col("k") - 1) / 2).otherwise(F.col("__within"))
    return within.join(of, ["signal", "__cell"]).withColumn(name, rank).drop("__cell", "__deal", "__within", "before", "k")


def _median(which: str, name: str) -> Column:
    """The middle value, or the mean of the two in the middle, from values with ``k`` rows and ``before`` smaller ones."""
    holds = lambda at: ((F.col("before") <= at) & (at < F.col("before") + F.col("k"))).cast("int")
    share = (holds(F.floor((F.col("n") - 1) / 2)) + holds(F.floor(F.col("n") / 2))) / 2
    return F.sum(F.when((F.col("which") == which) & (share > 0), F.col("value") * share)).alias(name)


def _pooled(t: DataFrame) -> DataFrame:
    """:func:`pooled` of observations ``signal, sig, fwd`` that are kept as a table. Rows are dealt once for each of the
    two ranks; cuts only even out the cells, whose rows are counted."""
    points = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    quantiles = [F.sort_array(F.percentile_approx(c, points, 5000)).alias(f"__{c}") for c in ("sig", "fwd")]
    cuts = cut(t.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), *quantiles))
    cells = lambda c: _celled(t.select("signal", c), cuts, c).select("signal", F.lit(c).alias("which"), F.col("__cell").alias("cell"),
        F.col(c).alias("value"))
    each = cells("sig").unionByName(cells("fwd"))
    earlier = Window.partitionBy("signal", "which").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("signal", "which", "cell").agg(F.count(F.lit(1)).alias("k"))
    sizes = cut(counts.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))))
    n = cuts.select("signal", "n")
    middle = sizes.join(n, "signal").where("before <= floor(n / 2) and floor((n - 1) / 2) < before + k").drop("k")
    values = each.join(F.broadcast(middle), ["signal", "which", "cell"]).groupBy("signal", "which", "cell", "before", "n",
        "value").agg(F.count(F.lit(1)).alias("k"))
    smaller = Window.partitionBy("signal", "which", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(smaller), F.lit(0)))
    mid = values.groupBy("signal").agg(_median("sig", "ms"), _median("fwd", "mf"))
    agree = ((F.col("sig") > F.col("ms")) == (F.col("fwd") > F.col("mf"))).cast("double")
    enough = F.count(F.lit(1)) >= 10
    flags = t.join(F.broadcast(mid), "signal").groupBy("signal").agg(F.when(enough, F.avg(agree)).alias("hit"),
        F.when(enough, F.avg((F.col("fwd") > 0).cast("double"))).alias("base"))
    ranks = _ranked(_ranked(t, cuts, sizes, "sig", "rs").drop("sig"), cuts, sizes, "fwd", "rf")
    return flags.join(ranks.groupBy("signal").agg(_rank_corr().alias("pooled_ic")), "signal")


def pooled(long: DataFrame, obs_step: int) -> DataFrame:
    """``signal, hit, base, pooled_ic`` over every ``obs_step``-th observation: agreement of above-median flags and
    share of positive forward returns (null under 10), and the rank correlation. Ranks and medians come from counts
    of values, so a signal of any length fits."""
    return _pooled(cut(thinned(long, obs_step).select("signal", "sig", "fwd")))


def hit_and_base(long: DataFrame, obs_step: int) -> DataFrame:
    return pooled(long, obs_step).select("signal", "hit", "base")


def pooled_ic(long: DataFrame, obs_step: int) -> DataFrame:
    return pooled(long, obs_step).select("signal", "pooled_ic")


def p_two_sided(t: float | None) -> float | None:
    """Two-sided normal p value."""
    return None if t is None else math.erfc(abs(t) / math.sqrt(2))


def scorecard(long: DataFrame, horizon: int, lag: int | None = None, cost_bps: float = COST_BPS, step: int | None = None) -> DataFrame:
    """All scores of each signal in one row; pooled ones over every ``step``-th observation (None: every ``horizon``-th)."""
    ic = newey_west(by_date(long), horizon - 1 if lag is None else lag, F.avg("spread").alias("spread"))
    return ic.withColumn("net", net_spread(F.col("spread"), cost_bps)).join(pooled(long, step or horizon), "signal", "left")


def dealt(long: DataFrame) -> DataFrame:
    """``long`` computed once and dealt by signal and date, as all scores group it: none of them shuffles it again."""
    return cut(long.repartition("signal", "date"))


def _scored(wide: DataFrame, names: list[str], obs_step: int) -> tuple[DataFrame, DataFrame]:
    """:func:`by_date` and :func:`thinned` of signals in columns, ``signal`` being the column's place in ``names``. Bars
    are dealt by date once, with all their signals, and both results are computed from there and kept. All three uses
    of the dealt bars read the same columns under the same conditions, so that Spark deals them once."""
    some = F.col("fwd").isNotNull() & F.coalesce(*names).isNotNull()
    rows = wide.where(some).select("symbol", "date", "fwd", *names).repartition("date")
    signals = lambda *more: F.explode(F.array(*[F.struct(F.lit(i).alias("signal"), F.col(c).alias("sig"), *[m(i) for m in more])
        for i, c in enumerate(names)])).alias("of")
    scores = by_date(rows.select("symbol", "date", "fwd", signals()).select("of.signal", "symbol", "date", "of.sig", "fwd").where("sig is not null"))
    so_far = Window.partitionBy("date").orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumns({f"__n{i}": F.count(F.when(F.col("fwd").isNotNull(), F.col(c))).over(so_far) for i, c in enumerate(names)})
    ends = numbered.groupBy("date").agg(*[F.max(f"__n{i}").alias(f"__n{i}") for i in range(len(names))])
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("date").alias("__date"), *[F.coalesce(F.sum(f"__n{i}").over(before), F.lit(0)).alias(f"__s{i}") for i in range(len(names))])
    place = lambda i: (F.col(f"__s{i}") + F.col(f"__n{i}") - 1).alias("at")
    kept = numbered.join(F.broadcast(starts), F.col("date").eqNullSafe(F.col("__date"))).select("fwd", signals(place)).where(F.col("of.sig").isNotNull() & (F.col("of.at") % obs_step == 0))
    both = scores.withColumn("what", F.lit("date")).unionByName(kept.select("of.signal", "of.sig", "fwd", F.lit("row").alias("what")), True)
    both = cut(both, "what")
    of = lambda what, *cols: both.where(F.col("what") == what).select(*cols)
    return of("date", "signal", "date", "n", "ic", "spread"), of("row", "signal", "sig", "fwd")


def wide_scorecard(wide: DataFrame, signals: list[str], lag: list[int], cost_bps: float, step: int) -> DataFrame:
    """:func:`scorecard` of signals in columns, each with a ``lag`` of its own; ``signal`` is the place in ``signals``."""
    dates, rows = _scored(wide, signals, step)
    ics = [newey_west(dates.where(F.col("signal").isin([i for i, x in enumerate(lag) if x == k])), k, F.avg("spread").alias("spread"))
        for k in sorted(set(lag))]
    ic = reduce(DataFrame.unionByName, ics)
    return ic.withColumn("net", net_spread(F.col("spread"), cost_bps)).join(_pooled(rows), "signal", "left")


def price_scorecard(prices: DataFrame, horizon: int) -> DataFrame:
    """:func:`scorecard` of all price signals."""
    wide, names = _wide_price_signals(_own(prices), horizon)
    return _named(wide_scorecard(wide, names, [horizon - 1] * len(names), COST_BPS, horizon), {"signal": names})


def _named(scores: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """``scores`` with columns of names in place of ``signal``, the place in them."""
    at = F.col("signal")
    cols = [F.get(F.array(*[F.lit(x) for x in of]), at).alias(c) for c, of in names.items()]
    return scores.select(cols[0], *[c for c in scores.columns if c not in names], *cols[1:])


SURVIVORSHIP = {
    True: "universe: holdings and the declared sold or delisted names; names not declared still bias it",
    False: "universe: current holdings only, so survivors alone are scored; declare sold and delisted names",
}


def evaluate(
    prices: DataFrame, quarters: DataFrame, horizon: int = 21, cost_bps: float = COST_BPS, declared: bool = False, with_rsi: bool = True,
    as_of: str | None = None, step: int | None = None, vintage_asof: str | None = None, universe: DataFrame | None = None,
) -> DataFrame:
    """A row for each price signal (``kind`` price) and fundamental signal (``kind`` fundamental, on every
    ``horizon``-th date and with lag 1), with all scores, ``n_signals``, ``significant`` at 5 %, ``bonferroni_alpha``
    (5 % over the number of signals), ``survives`` at that, and a note on the universe.

    ``as_of`` leaves out later bars; quarters need no cut, as one that wasn't public yet meets no date. With ``vintage_asof``
    ``prices`` are vintages (with ``vintage_date``), and each bar is the one known on that day, so a later restatement
    doesn't change the result. ``step`` thins the pooled scores apart from the horizon. Only names of ``universe``
    (``symbol``) are scored, if given: holdings and the declared names.
    """
    if vintage_asof is None:
        prices = pit.as_of_filter(prices, "date", as_of)
    else:
        prices = pit.known_at(prices.select("symbol", "date", "adj_close", "vintage_date"), vintage_asof, as_of)
    prices = prices if universe is None else prices.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    own = _own(prices)
    of_prices, names = _wide_price_signals(own, horizon, with_rsi=with_rsi)
    reported = _wide_fundamental_signals(own, quarters, horizon)
    kinds, every = ["price"] * len(names) + ["fundamental"] * len(FUNDAMENTAL_SIGNALS), names + FUNDAMENTAL_SIGNALS
    columns = [f"__{k}_{n}" for k, n in zip(kinds, every)]
    called = lambda df, kind: df.select("symbol", "date", "fwd", *[F.col(n).alias(c) for c, k, n in zip(columns, kinds, every) if k == kind])
    wide = called(of_prices, "price").unionByName(called(reported, "fundamental"), allowMissingColumns=True)
    lags = [max(1, horizon - 1) if k == "price" else 1 for k in kinds]
    scores = wide_scorecard(wide, columns, lags, cost_bps, step or horizon)
    rows = cut(_named(scores, {"signal": every, "kind": kinds}))
    n = rows.agg(F.count(F.lit(1)).cast("int").alias("n_signals"))
    each = rows.crossJoin(n).withColumn("bonferroni_alpha", F.round(0.05 / F.col("n_signals"), 4))
    beyond = lambda alpha: F.coalesce(p_value(F.col("t")) < alpha, F.lit(False))
    flags = {"significant": beyond(F.lit(0.05)), "survives": beyond(F.col("bonferroni_alpha")), "survivorship": F.lit(SURVIVORSHIP[declared])}
    return each.withColumns(flags)


def p_value(t: Column) -> Column:
    """Two-sided normal p value of each signal's t; the engine has no error function, and signals are few."""

    @F.pandas_udf("double")
    def p_values(x: pd.Series) -> pd.Series:
        return x.map(p_two_sided, na_action="ignore").astype(float)

    return p_values(t)


def with_bonferroni(scores: DataFrame) -> list[dict]:
    """Rows of a scorecard - one a signal, so a few - with p values and flags at 5 % and at 5 % over their number."""
    rows = [r.asDict() for r in scores.collect()]
    alpha = round(0.05 / max(1, len(rows)), 4)
    for r in rows:
        p = p_two_sided(r["t"])
        r |= {"p": p, "significant": p is not None and p < 0.05, "bonferroni_alpha": alpha, "survives": p is not None and p < alpha}
    return rows


def t_for(p: float) -> float:
    """The t value whose two-sided p value is ``p``, by bisection."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p_two_sided(mid) > p else (lo, mid)
    return (lo + hi) / 2


def sector_neutral(long: DataFrame, meta: DataFrame) -> DataFrame:
    """Signals less their sector's mean of the date; a name alone in its sector becomes 0, names without one go."""
    w = Window.partitionBy("signal", "date", "sector")
    return long.join(meta.where("sector is not null"), "symbol").withColumn("sig", F.col("sig") - F.avg("sig").over(w))


def xs_zscore(long: DataFrame) -> DataFrame:
    """``z`` across names of each date and signal; null where they don't differ."""
    w = Window.partitionBy("signal", "date")
    return long.withColumn("z", F.try_divide(F.col("sig") - F.avg("sig").over(w), F.nullif(F.stddev_pop("sig").over(w), F.lit(0.0))))


def composite(long: DataFrame, signs: dict[str, int]) -> DataFrame:
    """``symbol, date, fwd, sig``: signed mean of the z scores that a name has."""
    sign = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv])
    z = xs_zscore(long.where(F.col("signal").isin(*signs)))
    return z.groupBy("symbol", "date").agg(F.max("fwd").alias("fwd"),
        F.try_divide(F.sum(F.try_element_at(sign, F.col("signal")) * F.col("z")), F.count("z")).alias("sig")).where("sig is not null")
