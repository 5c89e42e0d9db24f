"""Cards and what is read off them: attention, confidence, changes, alerts. All are projections on nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import latest_by
from tidemark.operators.risk import LIMITS

# Attention points and directions of each dial's states, weights of the dimensions, sector limit.
MOMENTUM_POINTS = {"overbought": 85, "oversold": 85, "strong": 45, "weak": 45, "neutral": 15}
LEVEL_POINTS = {"at highs": 70, "near lows": 70, "mid-range": 20}
TREND_POINTS = {"downtrend": 55, "sideways": 30, "uptrend": 20}
GROWTH_POINTS = {"declining": 85, "flat": 50, "growing": 25, "strong": 40}
MARGIN_POINTS = {"contracting": 80, "stable": 20, "expanding": 40}
TREND_SIGNS = {"uptrend": 1, "sideways": 0, "downtrend": -1}
MOMENTUM_SIGNS = {"overbought": 1, "strong": 1, "neutral": 0, "weak": -1, "oversold": -1}
LEVEL_SIGNS = {"at highs": 1, "mid-range": 0, "near lows": -1}
GROWTH_SIGNS = {"strong": 1, "growing": 1, "flat": 0, "declining": -1}
MARGIN_SIGNS = {"expanding": 1, "stable": 0, "contracting": -1}
SENTIMENT_SIGNS = {"positive": 1, "neutral": 0, "negative": -1}
WEIGHTS = {"risk": 1.0, "technical": 1.0, "fundamental": 1.0, "macro": 1.0, "sentiment": 0.5, "ownership": 0.5}
SECTOR_LIMIT_PCT = 40.0
DIALS = ("trend", "momentum", "level", "revenue_growth", "earnings_growth", "margin_trend", "sentiment", "institutional")

#: Columns of a flat card, each null where its dimension has no reading.
CARD = {
    "symbol": "string", "last_close": "double", "risk_contribution_pct": "double", "weight_pct": "double", "trend": "string",
        "momentum": "string", "level": "string", "rsi_14": "double",
    "pct_from_52w_high": "double", "sma200": "double", "latest_quarter": "date", "revenue_growth": "string", "earnings_growth": "string",
        "margin_trend": "string", "net_income_yoy_pct": "double",
    "guidance": "boolean", "sector": "string", "sector_weight_pct": "double", "sentiment": "string", "mean_polarity": "double",
        "n_articles": "bigint", "institutional": "string", "institutional_pct": "double",
}


def _looked_up(table: dict[str, int], key: str) -> Column:
    out = F.lit(None).cast("double")
    for state, value in table.items():
        out = F.when(F.col(key) == state, F.lit(float(value))).otherwise(out)
    return out


def _present(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def _clamp(x: Column, given: Column) -> Column:
    return F.when(given.isNotNull(), _clamped(x))


def _pct0(x: Column) -> Column:
    """Without decimals, halves to even; what rounds to zero from below keeps its sign."""
    return F.when((x < 0) & (F.rint(x) == 0), F.lit("-0")).otherwise(F.rint(x).cast("bigint").cast("string"))


def build_cards(technical: DataFrame, risk=None, fundamental=None, macro=None, sentiment=None, ownership=None, guidance=None) -> DataFrame:
    """Flat cards, one for each symbol with a technical reading; the other dimensions join on if they are there."""
    out = technical.select("symbol", "last_close", "trend", "momentum", "level", "rsi_14", "pct_from_52w_high", "sma200")
    if fundamental is not None:
        fundamental = fundamental.withColumnRenamed("period_end", "latest_quarter")
    if sentiment is not None:
        sentiment = sentiment.withColumnRenamed("label", "sentiment")
    if guidance is not None:
        guidance = guidance.select("symbol", F.lit(True).alias("guidance"))
    for part in (risk, fundamental, macro, sentiment, ownership, guidance):
        if part is not None:
            out = out.join(part.select(*[c for c in part.columns if c == "symbol" or c in CARD and c not in out.columns]), "symbol", "left")
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in CARD.items()])


def ordered(cards: DataFrame) -> DataFrame:
    """Cards by risk contribution, largest first, those without one last."""
    return cards.orderBy(F.desc_nulls_last("risk_contribution_pct"), "symbol")


def subscores() -> dict[str, Column]:
    c = F.col
    return {
        "risk": _clamp(100 * c("risk_contribution_pct") / LIMITS["max_name_risk_pct"], c("risk_contribution_pct")),
        "technical": _mean(_present([_looked_up(MOMENTUM_POINTS, "momentum"), _looked_up(LEVEL_POINTS, "level"), _looked_up(TREND_POINTS, "trend")])),
        "fundamental": _mean(_present([_looked_up(GROWTH_POINTS, "revenue_growth"), _looked_up(GROWTH_POINTS, "earnings_growth"),
            _looked_up(MARGIN_POINTS, "margin_trend")])),
        "macro": _clamp(100 * c("sector_weight_pct") / SECTOR_LIMIT_PCT, c("sector_weight_pct")),
        "sentiment": _clamp(F.abs("mean_polarity") * 100, c("mean_polarity")),
        "ownership": _clamp(F.abs(c("institutional_pct") - 50) * 1.4, c("institutional_pct")),
    }


def drivers() -> Column:
    """Up to four reasons for attention, in the order of the dimensions."""
    c, limit = F.col, LIMITS["max_name_risk_pct"]
    rc, wt = c("risk_contribution_pct"), c("weight_pct")
    risk = (
        F.when(rc >= limit, F.concat(F.lit("top risk contributor — "), _pct0(rc), F.lit(f"% of book risk (≥ {limit:.0f}% limit)")))
        .when((wt != 0) & (rc > wt * 1.2), F.concat(F.lit("risk-dense: "), _pct0(rc), F.lit("% of risk vs "), _pct0(wt), F.lit("% of capital")))
        .when(rc >= 25, F.concat(_pct0(rc), F.lit("% of book risk")))
    )
    momentum = F.when(c("momentum").isin("overbought", "oversold"), F.concat(c("momentum"),
        F.coalesce(F.concat(F.lit(" (RSI "), _pct0(F.when(c("rsi_14").isNotNull(), c("rsi_14"))), F.lit(")")), F.lit(""))))
    level = F.when(c("level").isin("at highs", "near lows"), F.concat(c("level"), F.lit(" ("), _pct0(c("pct_from_52w_high")),
        F.lit("% from 52w high)")))
    earnings = F.when(c("earnings_growth") == "declining", F.concat(F.lit("earnings declining ("), _pct0(c("net_income_yoy_pct")), F.lit("% YoY)")))
    sector = F.when(c("sector_weight_pct") >= SECTOR_LIMIT_PCT, F.concat(F.coalesce("sector", F.lit("sector")), F.lit(" is "),
        _pct0(c("sector_weight_pct")), F.lit("% of the book")))
    news = F.when(c("sentiment").isin("positive", "negative") & (F.abs("mean_polarity") >= 0.3), F.concat(c("sentiment"),
        F.lit(" news flow ("), c("n_articles").cast("string"), F.lit(" headlines)")))
    inst = F.when((c("institutional_pct") >= 70) | (c("institutional_pct") <= 15), F.concat(F.lit("institutional holding "),
        _pct0(c("institutional_pct")), F.lit("%")))
    found = _present([risk, momentum, level, F.when(c("trend") == "downtrend", F.lit("in a downtrend")), earnings,
        F.when(c("margin_trend") == "contracting", F.lit("margins contracting")), sector, news, inst])
    return F.slice(found, 1, 4)


def attention(cards: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``cards`` with sub-scores ``s_*``, ``attention`` (their weighted mean over the dimensions there) and ``drivers``."""
    subs = {d: F.round(s, 1) for d, s in subscores().items()}
    w = WEIGHTS | (weights or {})
    scored = cards.withColumns({f"s_{d}": s for d, s in subs.items()})
    num = _sum(_present([F.col(f"s_{d}") * w[d] for d in subs]))
    den = _sum(_present([F.when(F.col(f"s_{d}").isNotNull(), F.lit(float(w[d]))) for d in subs]))
    return scored.withColumns({"attention": F.round(F.when(den > 0, num / den + 1e-9), 1), "drivers": drivers()})


def confidence(cards: DataFrame) -> DataFrame:
    """``cards`` with ``confidence`` (0 to 1), ``confidence_level`` and ``n_present``: completeness, depth, coherence."""
    c = F.col
    quarter = c("latest_quarter").isNotNull()
    dims = [c("risk_contribution_pct").isNotNull(), c("trend").isNotNull(), quarter | F.coalesce("guidance", F.lit(False)),
        c("sector_weight_pct").isNotNull(), c("sentiment").isNotNull(), c("institutional").isNotNull()]
    count = lambda flags: sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    signs = _present([_looked_up(TREND_SIGNS, "trend"), _looked_up(MOMENTUM_SIGNS, "momentum"), _looked_up(LEVEL_SIGNS, "level"),
        _looked_up(GROWTH_SIGNS, "earnings_growth"), _looked_up(MARGIN_SIGNS, "margin_trend"), _looked_up(SENTIMENT_SIGNS, "sentiment")])
    size = _sum(F.transform(signs, F.abs))
    coherence = F.when(F.size(signs) < 2, 0.5).when(size == 0, 0.5).otherwise(F.abs(_sum(signs)) / F.nullif(size, F.lit(0.0)))
    depth = count([quarter, c("sma200").isNotNull(), F.coalesce("guidance", F.lit(False))]) / 3
    out = cards.withColumns({"n_present": count(dims), "confidence": F.round(0.4 * count(dims) / 6 + 0.3 * depth + 0.3 * coherence, 2)})
    return out.withColumn("confidence_level", F.when(c("confidence") >= 0.66, "high").when(c("confidence") >= 0.4, "medium").otherwise("low"))


def snapshot(scored: DataFrame) -> DataFrame:
    """What a run keeps of each card."""
    return scored.select("symbol", "attention", *DIALS, "risk_contribution_pct")


def changes(snapshots: DataFrame, prior: DataFrame, attention_step: float = 5.0, risk_step: float = 3.0) -> DataFrame:
    """``snapshots`` with ``changes``: dials that flipped and numbers that moved by a step; none on a first run."""
    before = prior.select("symbol", *[F.col(c).alias(f"__{c}") for c in ("attention", *DIALS, "risk_contribution_pct")])
    arrow = F.lit(" → ")
    flips = [F.when(F.col(f"__{d}") != F.col(d), F.concat(F.lit(f"{d} "), F.col(f"__{d}"), arrow, F.col(d))) for d in DIALS]
    a, pa, r, pr = F.col("attention"), F.col("__attention"), F.col("risk_contribution_pct"), F.col("__risk_contribution_pct")
    moves = [
        F.when(F.abs(a - pa) >= attention_step, F.concat(F.lit("attention "), _pct0(pa), arrow, _pct0(a))),
        F.when(F.abs(r - pr) >= risk_step, F.concat(F.lit("risk contribution "), _pct0(pr), F.lit("%"), arrow, _pct0(r), F.lit("%"))),
    ]
    joined = snapshots.join(before, "symbol", "left").withColumn("changes", _present(flips + moves))
    return joined.select(*snapshots.columns, "changes")


def latest_snapshots(history: DataFrame) -> DataFrame:
    """The last run of every symbol at once."""
    return latest_by(history, ["symbol"], F.col("run_at")).drop("run_at")


def default_rules() -> list[Column]:
    """Alert rules: each gives a message or null. Pass a list of your own to :func:`alerts` to change them."""
    c, limit = F.col, LIMITS["max_name_risk_pct"]
    rc = c("risk_contribution_pct")
    return [
        F.when(rc >= limit, F.concat(F.lit("top risk contributor — "), _pct0(rc), F.lit(f"% of book risk (≥ {limit:.0f}% limit)"))),
        F.when((c("trend") == "downtrend") & (c("level") == "near lows"), F.lit("in a downtrend and near 52-week lows")),
        F.when(c("earnings_growth") == "declining", F.concat(F.lit("earnings declining"),
            F.when(c("net_income_yoy_pct").isNull(), "").otherwise(F.concat(F.lit(" ("), _pct0(c("net_income_yoy_pct")), F.lit("% YoY)"))))),
        F.when(c("margin_trend") == "contracting", F.lit("margins contracting")),
        F.when(c("sentiment") == "negative", F.concat(F.lit("negative news flow ("), c("n_articles").cast("string"), F.lit(" headlines)"))),
        F.when(F.size("changes") > 0, F.concat(F.lit("changed since last run — "), F.concat_ws("; ", "changes"))),
    ]


def alerts(cards: DataFrame, rules: list[Column] | None = None) -> DataFrame:
    df = cards if "changes" in cards.columns else cards.withColumn("changes", F.array().cast("array<string>"))
    return df.withColumn("alerts", _present(default_rules() if rules is None else rules))


def briefing(cards: DataFrame) -> DataFrame:
    """``symbol, attention, confidence_level, alerts, flagged``, most attention first."""
    out = alerts(cards).select("symbol", "attention", "confidence_level", "alerts", (F.size("alerts") > 0).alias("flagged"))
    return out.orderBy(F.desc_nulls_last("attention"), "symbol")
