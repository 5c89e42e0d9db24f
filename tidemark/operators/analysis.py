"""The analysis of a book: from positions, bars, quarters, sectors, news, ownership and guidance to scored, ordered cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import places
from tidemark.operators import factors, fundamental, guidance, macro, pit, risk, scoring, technical, text


@dataclass
class Feeds:
    """What is known of the names. Prices are needed; what else is missing leaves its dimension without a reading.

    ``prices``: ``symbol, date, close, adj_close, volume``; ``market``: bars of the benchmark; ``quarters``; ``sectors``:
    ``symbol, sector``; ``news``: ``symbol, published, text`` or ``polarity``; ``ownership``: snapshots with
    ``snapshot_at``; ``guidance`` and ``filings``: records of guidance and the chunks that tell when they were filed.
    """

    prices: DataFrame
    market: DataFrame | None = None
    quarters: DataFrame | None = None
    sectors: DataFrame | None = None
    news: DataFrame | None = None
    ownership: DataFrame | None = None
    guidance: DataFrame | None = None
    filings: DataFrame | None = None

    def known(self, as_of: str | None) -> Feeds:
        """What was known by midnight of ``as_of``: no later bar, headline or snapshot, and no quarter before it was
        announced. Rows without a date are unknown then."""
        if as_of is None:
            return self
        by = lambda df, column: None if df is None else pit.as_of_filter(df, column, as_of)
        return Feeds(by(self.prices, "date"), by(self.market, "date"), None if self.quarters is None else pit.announced(self.quarters, as_of),
            self.sectors, by(self.news, "published"), by(self.ownership, "snapshot_at"), self.guidance, self.filings)


@dataclass
class Options:
    """``sampled`` turns bars to those whose returns are compared (daily bars as they are, or :func:`risk.month_ends`),
    ``year`` says how many of them a year has. ``tiles`` is the number of covariance tiles (None: by the names)."""

    as_of: str | None = None
    horizon: str | int = "annual"
    sampled: Callable[[DataFrame], DataFrame] = lambda prices: prices
    year: int = risk.YEAR_DAYS
    tiles: int | None = None
    weights: dict[str, float] = field(default_factory=dict)


def horizon_days(options: Options) -> int:
    """Rows of the sample that the horizon has."""
    days, _ = risk.horizon(options.horizon)
    return max(1, round(days * options.year / risk.YEAR_DAYS))


def position_risk(positions: DataFrame, feeds: Feeds, options: Options = Options()) -> DataFrame:
    """``symbol, weight_pct, vol_pct, mctr, risk_contribution_pct, portfolio_vol_pct, beta, max_drawdown_pct,
    market_value, unrealised_pct`` of each position with a price. Shares of risk and volatilities, at the horizon, are
    those of the shrunk covariance on the dates that all held names have; null where there is none."""
    feeds = feeds.known(options.as_of)
    weighted = macro.weights(positions, feeds.prices)
    rets = risk.returns(options.sampled(feeds.prices.join(weighted.select("symbol"), "symbol", "left_semi")))
    cov = factors.shrunk(factors.factors(risk.common_sample(rets), n_tiles=options.tiles))
    out = weighted.select("symbol", "market_value", (F.col("weight") * 100).alias("weight_pct"),
        (risk.unrealised_pct(F.col("last_close"), F.col("avg_cost")) if "avg_cost" in positions.columns else F.lit(None).cast("double")).alias(
            "unrealised_pct"))
    shares = factors.risk_contribution(cov, weighted, horizon_days(options)).drop("weight_pct")
    falls = pit.drawdown(feeds.prices)
    out = out.join(shares, "symbol", "left").join(falls, "symbol", "left")
    if feeds.market is None:
        return out.withColumn("beta", F.lit(None).cast("double"))
    market = risk.returns(options.sampled(feeds.market)).select("date", "ret")
    return out.join(risk.betas(rets, market), "symbol", "left")


def readings(positions: DataFrame, feeds: Feeds, options: Options = Options()) -> dict[str, DataFrame]:
    """What each dimension says of the names: ``technical``, ``risk``, and those whose feeds are there of ``fundamental``,
    ``macro``, ``sentiment``, ``ownership`` and ``guidance``."""
    known = feeds.known(options.as_of)
    out = {"technical": technical.technical(known.prices), "risk": position_risk(positions, feeds, options)}
    if known.quarters is not None:
        out["fundamental"] = fundamental.fundamental(known.quarters)
    if known.sectors is not None:
        out["macro"] = macro.macro_by_symbol(macro.weights(positions, known.prices), known.sectors)
    if known.news is not None:
        scored = known.news if "polarity" in known.news.columns else known.news.withColumn("polarity", text.polarity(F.col("text")))
        out["sentiment"] = text.sentiment(scored)
    if known.ownership is not None:
        out["ownership"] = text.ownership(known.ownership)
    if known.guidance is not None:
        filings = known.filings if known.filings is not None else known.guidance.select("symbol", "source", F.lit(None).cast("date").alias("filing_date"))
        out["guidance"] = guidance.latest_guidance(known.guidance, filings, options.as_of)
    return out


def cards(positions: DataFrame, feeds: Feeds, options: Options = Options(), prior: DataFrame | None = None) -> DataFrame:
    """A card for each name with a technical reading: the columns of a flat card, the position's risk, sub-scores,
    ``attention``, ``drivers``, ``confidence``, ``changes`` since the ``prior`` snapshots, ``alerts``, and ``place``, its
    place by share of risk (largest first, names without one last, ties by symbol)."""
    return cards_of(readings(positions, feeds, options), options, prior)


def cards_of(read: dict[str, DataFrame], options: Options = Options(), prior: DataFrame | None = None) -> DataFrame:
    """:func:`cards` from :func:`readings`."""
    flat = scoring.build_cards(read["technical"], *[read.get(name) for name in ("risk", "fundamental", "macro", "sentiment", "ownership",
        "guidance")])
    extra = read["risk"].select("symbol", "vol_pct", "mctr", "portfolio_vol_pct", "beta", "max_drawdown_pct", "market_value", "unrealised_pct")
    scored = scoring.confidence(scoring.attention(flat.join(extra, "symbol", "left"), options.weights))
    if prior is not None:
        scored = scored.join(scoring.changes(scoring.snapshot(scored), prior).select("symbol", "changes"), "symbol", "left")
    return placed(scoring.alerts(scored))


def placed(cards_: DataFrame) -> DataFrame:
    """``cards_`` with ``place``: by share of risk, largest first, those without one last, ties by symbol."""
    share = F.col("risk_contribution_pct")
    return places(cards_, [share.isNull(), -share, F.col("symbol")])


def portfolio(positions: DataFrame, feeds: Feeds, options: Options = Options()) -> DataFrame:
    """One row on the whole book: ``n_positions, market_value, portfolio_vol_pct, top_symbol, top_risk_pct, portfolio_beta,
    hhi, effective_holdings``, and the sectors' ``top_sector, top_sector_pct, concentration`` if sectors are known."""
    at_risk = position_risk(positions, feeds, options)
    share = F.col("weight_pct") / 100
    out = at_risk.agg(F.count(F.lit(1)).alias("n_positions"), F.sum("market_value").alias("market_value"),
        F.max("portfolio_vol_pct").alias("portfolio_vol_pct"), F.max_by("symbol", F.struct("risk_contribution_pct", "symbol")).alias("top_symbol"),
        F.max("risk_contribution_pct").alias("top_risk_pct"), F.sum(share * F.col("beta")).alias("portfolio_beta"),
        F.sum(share * share).alias("hhi"), F.try_divide(F.lit(1.0), F.sum(share * share)).alias("effective_holdings"))
    if feeds.sectors is None:
        return out
    weighted = macro.weights(positions, feeds.known(options.as_of).prices)
    top = macro.macro_portfolio(macro.sector_weights(weighted, feeds.sectors)).select("top_sector", "top_sector_pct", "concentration")
    return out.crossJoin(F.broadcast(top))  # two single rows
