"""Readers of small files - books, symbol lists, documents, question sets - and the seam for vendor feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without ``#`` comments and blanks."""
    bare = F.trim(F.substring_index("value", "#", 1))
    return spark.read.text(path).select(bare.alias("line")).where("line <> ''")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, quantity, avg_cost`` of a book: no quantity is 0, no cost is null. An empty book is an error."""
    part = F.split("line", ",")
    number = lambda i: F.try_to_number(F.nullif(F.trim(F.get(part, i)), F.lit("")), F.lit("S999999999999.999999"))
    rows = _lines(spark, path).where(~F.lower("line").startswith("symbol"))
    out = rows.select(F.upper(F.trim(F.get(part, F.lit(0)))).alias("symbol"), F.coalesce(number(F.lit(1)).cast("double"),
        F.lit(0.0)).alias("quantity"), number(F.lit(2)).cast("double").alias("avg_cost"))
    if out.isEmpty():
        raise ValueError(f"{path}: no positions")
    return out


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, ord``: the first field of each line, upper case, in the file's order."""
    field = F.upper(F.trim(F.split_part("line", F.lit(","), F.lit(1))))
    rows = _lines(spark, path).select(field.alias("symbol"), F.monotonically_increasing_id().alias("ord"))
    return rows.where("symbol not in ('SYMBOL', '')")


def universe(*lists: DataFrame) -> DataFrame:
    """Union of symbol lists without repeats, in the order of first appearance."""
    out = None
    for i, x in enumerate(lists):
        one = x.select("symbol", F.struct(F.lit(i).alias("list"), F.col("ord")).alias("at"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("symbol").agg(F.min("at").alias("at")).orderBy("at").select("symbol")


def format_quantity(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def write_positions(rows: Iterable[tuple[str, float, float | None]], path: str, preamble: str = "# symbol,quantity,avg_cost") -> None:
    """Write a book, sorted by symbol. A book has a few hundred rows at most."""
    lines = [preamble, "symbol,quantity,avg_cost"]
    lines += [f"{s},{format_quantity(q)},{'' if c is None else format_quantity(c)}" for s, q, c in sorted(rows)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def edited(rows: list[tuple[str, float, float | None]], symbol: str, quantity: float | None,
    avg_cost: float | None = None) -> list[tuple[str, float, float | None]]:
    """The book with one holding replaced or added, or removed if there is no quantity."""
    kept = [r for r in rows if r[0] != symbol.upper()]
    return sorted(kept if quantity is None else [*kept, (symbol.upper(), quantity, avg_cost)])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``source, text`` of text files, one row a file; bytes that are no UTF-8 become replacement characters."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def read_binary_documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """``source, text`` of files that ``pages`` reads, such as a PDF library's text by page; pages are joined by a line
    feed. Files are dealt out one by one, and ``pages`` runs where they are read."""

    def parsed(batches):
        for pdf in batches:
            yield pd.DataFrame({"source": [p.rsplit("/", 1)[-1] for p in pdf["path"]], "text": ["\n".join(pages(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "source string, text string")


def book_or_universe(book: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols of the book, or all symbols if the book is empty."""
    return (symbols if book.isEmpty() else book).select("symbol")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="symbol string, question string, must_contain array<string>", multiLine=True)


class PriceSource(Protocol):
    """A vendor feed; each method gives rows for one symbol. Dated feeds may also take the days ``since`` and ``until``."""

    def bars(self, symbol: str): ...
    def quarters(self, symbol: str): ...
    def news(self, symbol: str): ...
    def meta(self, symbol: str): ...
    def ownership(self, symbol: str): ...


class MarketFlowSource(Protocol):
    def flows(self) -> dict | None: ...


class NoFlows:
    """The default: no source, no flows."""

    def flows(self) -> None:
        return None


def without_suffix(symbol):
    """Symbol without its exchange suffix, upper case."""
    return F.regexp_replace(F.upper(symbol), r"\.(NS|BO)$", "")


def company_names(symbols: DataFrame, meta: DataFrame) -> DataFrame:
    return symbols.join(meta.select("symbol", "name"), "symbol", "left").withColumn("name", F.coalesce("name", without_suffix(F.col("symbol"))))
