"""Headline reads: lexicon polarity, catalyst classes, news flow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The polarity lexicon.
POSITIVE = ("beat", "beats", "surge", "surges", "record", "strong", "growth", "grew", "upgrade", "upgrades", "profit", "profits", "gain",
    "gains", "rise", "rises", "win", "wins", "robust", "outperform", "jump", "jumps", "expansion", "expanding", "raised", "optimistic",
        "bullish", "recovery", "rally", "approval", "approved", "secures", "highest", "boost", "boosts")
NEGATIVE = ("miss", "misses", "fall", "falls", "drop", "drops", "slump", "weak", "decline", "declines", "downgrade", "downgrades", "loss",
    "losses", "cut", "cuts", "plunge", "probe", "fraud", "lawsuit", "default", "layoff", "layoffs", "warning", "warns", "bearish",
        "slowdown", "crisis", "penalty", "fine", "resign", "resigns", "scam", "raid", "halts", "recall", "downturn", "concern", "concerns")

# Catalyst classes in order of priority. Keywords of five characters or more match anywhere, shorter ones as tokens.
EVENT_RULES = (
    ("legal/probe", ("fraud", "probe", "lawsuit", "bail", "court", "penalty", "raid", "sebi", "investigat", "arrest", "detention",
        "bribery", "scam", "tribunal", "verdict", "appeal", "fine")),
    ("results", ("results", "earnings", "profit", "quarterly", "q1", "q2", "q3", "q4", "revenue", "margin", "ebitda", "topline",
        "net income", "miss", "beat")),
    ("guidance/outlook", ("guidance", "outlook", "forecast", "expects", "projects", "sees")),
    ("deal/order", ("order", "contract", "wins", "secures", "bags", "acquisition", "acquire", "stake", "merger", "joint venture",
        "partnership", "tie-up")),
    ("rating", ("upgrade", "downgrade", "rating", "overweight", "underweight", "price target", "initiate")),
    ("management", ("resign", "appoint", "ceo", "cfo", "chairman", "steps down", "quits", "board")),
    ("capex/expansion", ("capex", "expansion", "capacity", "plant", "factory", "commission", "greenfield")),
    ("capital", ("dividend", "buyback", "bonus", "rights issue", "qip", "fundrais", "stake sale")),
    ("regulatory", ("approval", "approved", "regulat", "clearance", "license", "tariff")),
)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def polarity(title: Column) -> Column:
    """(positive - negative) / (positive + negative) tokens; 0 without any."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z']+)"), 1)

    def share(found: Column) -> Column:
        p, n = (F.size(F.filter(found, lambda t: t.isin(*words))).cast("double") for words in (POSITIVE, NEGATIVE))
        return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))

    return _bound(tokens, share)


def event_class(title: Column, digits: bool = False) -> Column:
    """First catalyst class that matches, else null. Tokens hold no digits unless asked for, so q1 to q4 never match.
    Only the short keywords are looked for as tokens, all at once."""
    text = F.lower(F.coalesce(title, F.lit("")))
    inside = "[a-z0-9&/'-]" if digits else "[a-z&/'-]"
    short = sorted({w for _, words in EVENT_RULES for w in words if len(w) < 5 and re.fullmatch(f"{inside}+", w)})
    tokens = F.regexp_extract_all(text, F.lit(f"(?<!{inside})({'|'.join(short)})(?!{inside})"), 1)

    def first_class(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, words in reversed(EVENT_RULES):
            hit = F.lit(False)
            for w in words:
                hit = hit | x["text"].contains(w) if len(w) >= 5 else hit
            if mine := [w for w in words if w in short]:
                hit = hit | F.arrays_overlap(x["tokens"], F.array(*map(F.lit, mine)))
            out = F.when(hit, F.lit(label)).otherwise(out)
        return out

    return _bound(F.struct(text.alias("text"), tokens.alias("tokens")), first_class)


def sentiment_label(mean: Column) -> Column:
    return F.when(mean > 0.15, "positive").when(mean < -0.15, "negative").when(mean.isNotNull(), "neutral")


def sentiment(news: DataFrame) -> DataFrame:
    """Count, mean polarity and shares of each symbol's headlines."""
    p = F.col("polarity")
    out = news.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_articles"), F.avg(p).alias("mean_polarity"),
        F.avg((p > 0).cast("double")).alias("positive_share"), F.avg((p < 0).cast("double")).alias("negative_share"))
    return out.withColumn("label", sentiment_label(F.col("mean_polarity")))


def newest_headlines(news: DataFrame, per_symbol: int | None = 60, tie: str = "title") -> DataFrame:
    """Headlines newest first, undated last, at most ``per_symbol`` of each symbol."""
    if per_symbol is None:
        return news
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("published"), tie))
    return news.withColumn("n", n).where(F.col("n") <= per_symbol).drop("n")


def catalysts(news: DataFrame, title: str = "title") -> DataFrame:
    return news.withColumn("event", event_class(F.col(title))).where("event is not null")


def newsroom(news: DataFrame, symbol: str | None = None, sign: int | None = None, catalysts_only: bool = False,
    contains: str | None = None) -> DataFrame:
    """The news page's filters; needs columns ``polarity`` and ``event`` for those that use them."""
    df = news if symbol is None else news.where(F.col("symbol") == symbol)
    df = df if sign is None else df.where(F.signum("polarity") == sign)
    df = df.where("event is not null") if catalysts_only else df
    return df if contains is None else df.where(F.lower("title").contains(contains.lower()))


def feed(news: DataFrame, limit: int = 200) -> DataFrame:
    """The newest headlines over all symbols, undated ones last."""
    return news.orderBy(F.desc_nulls_last("published"), "symbol", "title").limit(limit)


def polarity_line(news: DataFrame) -> DataFrame:
    """Dated headlines with a polarity, oldest first."""
    return news.where("published is not null and polarity is not null").orderBy("published", "symbol", "title")


def ownership_level(pct: Column) -> Column:
    return F.when(pct >= 50, "high").when(pct >= 20, "moderate").when(pct.isNotNull(), "low")


def ownership(snapshots: DataFrame) -> DataFrame:
    """Percentages and dial of each symbol's latest snapshot; rows without either share are no reading."""
    known = snapshots.where("held_pct_institutions is not null or held_pct_insiders is not null")
    last = known.groupBy("symbol").agg(F.max_by(F.struct("held_pct_institutions", "held_pct_insiders", "n_institutions"), "snapshot_at").alias("r"))
    inst = F.round(F.col("r.held_pct_institutions") * 100, 1)
    return last.select("symbol", inst.alias("institutional_pct"), F.round(F.col("r.held_pct_insiders") * 100, 1).alias("insider_pct"),
        F.col("r.n_institutions").alias("n_institutions"), ownership_level(inst).alias("institutional"))
