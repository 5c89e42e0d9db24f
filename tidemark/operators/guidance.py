"""Management guidance: what was promised, when it was known, and what results followed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.payload import parsed, text_at, texts_at
from tidemark.functions.windows import places
from tidemark.operators.pit import ANNOUNCEMENT_LAG_DAYS

OUTLOOKS = ("revenue_outlook", "margin_outlook", "demand_commentary")
#: Questions whose hits an extraction reads, and hits kept of each and in all.
QUESTIONS = ("revenue growth outlook and guidance", "margin outlook and cost pressure", "demand commentary and order book",
    "capital expenditure and expansion plans")
HITS_EACH, HITS_ALL = 3, 6


def latest_guidance(records: DataFrame, chunks: DataFrame, as_of: str | None, tie: str = "extracted_at",
    lag_days: int = ANNOUNCEMENT_LAG_DAYS) -> DataFrame:
    """The newest record of each symbol that was known by ``as_of``: by the last filing date of its source's chunks,
    without one ``lag_days`` after the period. Undated records come last."""
    filed = chunks.groupBy("symbol", "source").agg(F.max("filing_date").alias("filed"))
    known = records.join(filed, ["symbol", "source"], "left").withColumn("known", F.coalesce("filed", F.date_add("period", lag_days)))
    known = known if as_of is None else known.where(F.col("known") <= F.lit(as_of).cast("date"))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("period"), F.desc(tie)))
    return known.withColumn("nth", newest).where("nth = 1").drop("nth", "known", "filed")


def guidance_of(records: DataFrame, chunks: DataFrame, symbol: str, as_of: str | None = None) -> DataFrame:
    """:func:`latest_guidance` of one symbol; the filter reaches both scans."""
    mine = F.col("symbol") == symbol.upper()
    return latest_guidance(records.where(mine), chunks.where(mine), as_of)


def merged_record(data: Column, source: Column, period: Column) -> Column:
    """JSON of a record's data with its source and period in front."""
    head = F.to_json(F.struct(source.alias("source"), period.cast("string").alias("period")))
    body = F.substr(F.trim(data), F.lit(2))
    return F.when(F.length(F.regexp_replace(data, r"[{}\s]", "")) == 0, head).otherwise(F.concat(F.regexp_replace(head, r"\}$", ","), body))


def guidance_history(records: DataFrame, as_of: str | None = None, tie: str = "extracted_at") -> DataFrame:
    """All records with content, oldest first, undated ones last. ``nth`` counts a symbol's records in that order.

    ``data`` is JSON or a variant, parsed once; a record without any outlook and without other guidance, or a symbol, is left out,
    as it promises nothing.
    """
    known = records if as_of is None else records.where(F.col("period").isNull() | (F.col("period") <= F.lit(as_of).cast("date")))
    rows = parsed(known, "data", "__v").withColumns({name: text_at("__v", f"$.{name}") for name in OUTLOOKS} | {"other_guidance": texts_at("__v",
        "$.other_guidance")})
    some = F.coalesce(F.size("other_guidance"), F.lit(0)) > 0
    for name in OUTLOOKS:
        some = some | F.col(name).isNotNull()
    there = rows.where(some & F.col("symbol").isNotNull()).drop("data", "__v")
    return places(there, [F.col("period").isNull(), F.col("period"), F.col(tie)], "nth", ["symbol"])


def actuals(quarters: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` quarters of each symbol, the yardstick of what was promised; ``nth`` counts from the oldest."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))
    last = quarters.where("period_end is not null").withColumn("back", back).where(F.col("back") <= n)
    margin = F.when(F.col("total_revenue") != 0, F.round(F.col("net_income") / F.col("total_revenue") * 100, 1))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("period_end"))
    return last.select("symbol", "period_end", "total_revenue", "net_income", margin.alias("net_margin_pct")).withColumn("nth", nth)


def crores(x: Column) -> Column:
    """Rupees in crores with thousands separated; without a figure ``n/a``."""
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(x / 1e7, 0), F.lit("cr")), F.lit("n/a"))


def promised_and_actual(history: DataFrame, results: DataFrame) -> DataFrame:
    """``symbol, n_guidance, promised, actual``: a line for each record and each quarter, oldest first: what a model
    that scores delivery is given. Figures are formatted here, so that no model scales numbers."""
    told = F.concat_ws(
        " | ", F.concat(F.lit("period "), F.coalesce(F.col("period").cast("string"), F.lit("unknown"))),
        *[F.concat(F.lit(f"{name}="), F.col(name)) for name in OUTLOOKS],
        F.when(F.size("other_guidance") > 0, F.concat(F.lit("other="), F.concat_ws("; ", "other_guidance"))),
    )
    lines = lambda line: F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"])
    given = history.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_guidance"), lines(told).alias("promised"))
    margin = F.concat(F.coalesce(F.col("net_margin_pct").cast("string"), F.lit("n/a")), F.lit("%"))
    came = F.concat(
        F.col("period_end").cast("string"), F.lit(": revenue "), crores(F.col("total_revenue")), F.lit(", net income "),
            crores(F.col("net_income")), F.lit(", net margin "), margin
    )
    after = results.groupBy("symbol").agg(lines(came).alias("actual"))
    none = F.array().cast("array<string>")
    return given.join(after, "symbol", "left").withColumn("actual", F.coalesce("actual", none))


def credibility(pairs: DataFrame, symbol: str, score: Callable[[list[str], list[str]], dict] | None = None) -> dict | None:
    """Whether a name delivered what it promised, by the callable's judgement; None without guidance on file. Without
    a callable, or when it fails, what is on file is counted and nothing is judged."""
    row = pairs.where(F.col("symbol") == symbol.upper()).first()
    if row is None:
        return None
    out = {"n_guidance": row.n_guidance, "track_record": f"{row.n_guidance} records of guidance on file", "checks": [], "caveat": "not scored"}
    if score is None:
        return out
    try:
        return out | score(row.promised, row.actual)
    except Exception as e:  # noqa: BLE001  a failing model leaves the count
        return out | {"caveat": f"not scored: {e}"}


def extract_guidance(symbol: str, hits: list[dict], period: str | None = None, extract: Callable[[list[dict]], dict] | None = None) -> dict:
    """A record read from retrieved chunks by the callable, to be stored, or the evidence alone. ``hits`` are those of
    all QUESTIONS, gathered."""
    if not hits or extract is None:
        return {"symbol": symbol, "stored": False, "hits": hits, "note": "no documents" if not hits else "nothing extracted without a model"}
    try:
        data = extract(hits)
    except Exception as e:  # noqa: BLE001  a failing model leaves the evidence
        return {"symbol": symbol, "stored": False, "hits": hits, "note": f"extraction failed: {e}"}
    return {"symbol": symbol, "stored": True, "hits": hits, "source": hits[0]["source"], "period": period, "data": data}
