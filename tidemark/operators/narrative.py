"""Texts made of readings: a card's digest, a verdict in words, provenance of a run, displayed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a view of one name alone that would be 100 % by construction.
RELATIVE = ("weight_pct", "risk_contribution_pct", "sector_weight_pct")


def single_name(cards: DataFrame, symbol: str) -> DataFrame:
    """A name's card without the fields that are relative to a book."""
    one = cards.where(F.col("symbol") == symbol.upper())
    return one.withColumns({c: F.lit(None).cast(t) for c, t in cards.dtypes if c in RELATIVE})


# The labels and the order of a digest's lines and of a verdict in words, as readers know them.


def _shown(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def digest(cards: DataFrame) -> DataFrame:
    """``symbol, digest``: a few lines that hold all that a verdict needs. A line without any reading is left out."""
    c = lambda name: _shown(F.col(name))
    lit = F.lit
    head = F.concat(F.col("symbol"), lit(" ₹"), c("last_close"), lit(" sector="), c("sector"))
    tech = F.concat(lit("TECH: trend="), c("trend"), lit(" mom="), c("momentum"), lit("(RSI "), c("rsi_14"), lit(") level="), c("level"))
    fund = F.when(
        F.col("latest_quarter").isNotNull(),
        F.concat(lit("FUND: rev "), c("revenue_growth"), lit(" · earn "), c("earnings_growth"), lit(" (NI YoY "), c("net_income_yoy_pct"),
            lit("%) · margin "), c("margin_trend")),
    )
    own = F.concat(lit("OWN: inst "), c("institutional_pct"), lit("%"))
    news = F.concat(lit("NEWS: "), c("sentiment"), lit(" ("), c("n_articles"), lit(" headlines)"))
    return cards.select("symbol", F.concat_ws("\n", head, tech, fund, own, news).alias("digest"))


def verdict_line(cards: DataFrame) -> DataFrame:
    """``symbol, verdict``: a read of the dials in words, for where no model is at hand."""
    c = lambda name: _shown(F.col(name))
    lit = F.lit
    tech = F.when(F.col("trend").isNotNull(), F.concat(lit("technically "), c("trend"), lit("/"), c("momentum"), lit(" at "), c("level")))
    growth = F.concat(c("revenue_growth"), lit(" rev / "), c("earnings_growth"), lit(" earnings / "), c("margin_trend"), lit(" margins"))
    fund = F.when(F.col("latest_quarter").isNotNull(), F.concat(lit("fundamentals "), growth))
    news = F.concat(F.col("sentiment"), lit(" news"))
    return cards.select("symbol", F.concat(F.concat_ws("; ", tech, fund, news), lit(".")).alias("verdict"))


def provenance(symbols: DataFrame, prices: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row: holdings, dates of the panel, and for each part how many symbols have any row of it (``n_<part>``)."""
    out = symbols.agg(F.countDistinct("symbol").alias("n_holdings")).crossJoin(prices.agg(F.countDistinct("date").alias("price_rows")))
    for name, df in parts.items():
        have = df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        out = out.crossJoin(have.agg(F.countDistinct("symbol").alias(f"n_{name}")))
    return out


def shares_left(a: Column, b: Column) -> Column:
    """What two percentages leave of a hundred, never below zero: neutral news, public float."""
    return F.greatest(F.lit(0.0), 100 - F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


def level(score: Column) -> Column:
    """Class of an attention score on display."""
    return F.when(score >= 66, "high").when(score >= 40, "medium").when(score.isNotNull(), "low")


def displayed(x: Column, places: int = 1, suffix: str = "", signed: bool = False) -> Column:
    """A number as shown: fixed places, thousands separated; a dash without one."""
    text = F.format_number(x, places)
    text = F.when(x > 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text
    return F.coalesce(F.concat(text, F.lit(suffix)), F.lit("—"))


def case_text(summary: str | None, points: list[tuple[str, str]]) -> str:
    """One side's case as text: its summary and a line for each point with its evidence."""
    return "(no data)" if summary is None else "\n".join([summary, *(f"  - {point} [{evidence}]" for point, evidence in points)])


def _tried(call: Callable, *args):
    try:
        return call(*args), None
    except Exception as e:  # noqa: BLE001  recorded in the result
        return None, str(e)


def deep_read(facts: str, specialists: dict[str, Callable[[str], dict]], judge: Callable[[str, dict], dict] | None) -> dict:
    """A reading by specialists side by side, reconciled by a judge. What fails is None in ``debate``; with no
    specialist's word, or no judge, the facts stand alone."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max(1, len(specialists))) as pool:
        words = dict(zip(specialists, pool.map(lambda call: _tried(call, facts)[0], specialists.values())))
    out = {"facts": facts, "debate": words, "deep": None}
    if judge is None or not any(w is not None for w in words.values()):
        return out
    deep, failed = _tried(judge, facts, words)
    return out | {"deep": deep} | ({"note": failed} if failed else {})


def ask_research(question: str, facts: str, deep: str | None, hits: list[dict], answer: Callable | None, as_of: str | None = None,
    web: Callable | None = None) -> dict:
    """An answer over facts, the last deep read and retrieved chunks. The web is asked only for today, never for a
    past date, as that would look ahead."""
    out = {"question": question, "facts": facts, "deep": deep, "hits": hits, "answer": None, "sources": []}
    if answer is None:
        return out
    search = web if as_of is None else None
    got, failed = _tried(answer, question, facts, deep, hits, search)
    return out | (got or {}) | ({"note": failed} if failed else {})
