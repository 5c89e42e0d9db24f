"""Vendor feeds as a data source of the engine: ``spark.read.format("vendor")`` over any :class:`files.PriceSource`."""

from __future__ import annotations

import datetime as dt
import inspect
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from pathlib import Path

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual
from pyspark.sql.datasource import In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMAS = {
    "bars": "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint",
    "quarters": "symbol string, period_end date, total_revenue double, operating_income double, net_income double, gross_profit double",
    "news": "symbol string, title string, publisher string, published timestamp",
    "meta": "symbol string, sector string, industry string, name string",
    "ownership": "symbol string, held_pct_institutions double, held_pct_insiders double, n_institutions int, snapshot_at timestamp",
}


#: The column of each feed that a range of dates bounds.
DATED = {"bars": "date", "quarters": "period_end", "news": "published"}


def made(path: str):
    """What the factory ``module:name`` gives."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)()


def _as_day(value: dt.date | dt.datetime) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


class VendorReader(DataSourceReader):
    """A partition for each symbol, so that feeds run side by side and one that fails is tried again alone.

    Filters on the symbol leave only the symbols asked for. Bounds of the feed's dates go to the vendor, as the days
    ``since`` and ``until``, if its method takes them; they stay with the engine too, as days are coarser than times.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.source, self.feed, self.columns = options["source"], options.get("feed", "bars"), columns
        self.symbols = list(dict.fromkeys(s.strip() for s in options["symbols"].split(",") if s.strip()))
        self.since: dt.date | None = None
        self.until: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "symbol" and isinstance(f, EqualTo | EqualNullSafe):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif column == "symbol" and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif column == "symbol" and isinstance(f, IsNotNull):
                pass
            else:
                if column == DATED.get(self.feed) and isinstance(getattr(f, "value", None), dt.date):
                    self._bound(f)
                yield f

    def _bound(self, f: Filter) -> None:
        day = _as_day(f.value)
        if isinstance(f, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual):
            self.since = max(self.since or day, day)
        if isinstance(f, EqualTo | EqualNullSafe | LessThan | LessThanOrEqual):
            self.until = min(self.until or day, day)

    def partitions(self):
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        fetch = getattr(made(self.source), self.feed)
        takes = inspect.signature(fetch).parameters
        bounds = {k: v for k, v in (("since", self.since), ("until", self.until)) if v is not None and k in takes}
        for row in fetch(partition.value, **bounds):
            row = {"symbol": partition.value} | {k.lower().replace(" ", "_"): _plain(v) for k, v in row.items()}
            if self.feed == "bars" and row.get("close") is None:
                continue
            yield tuple(row.get(c) for c in self.columns)


def _plain(value):
    """Missing values of numeric feeds are null."""
    return None if isinstance(value, float) and math.isnan(value) else value


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


class VendorWriter(DataSourceWriter):
    """Each task stages its rows under a token of its own; the driver publishes the tokens of the tasks that count once
    all have ended, or discards them. So neither a task that fails nor one that ran twice leaves rows."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.sink, self.feed, self.columns, self.overwrite = options["sink"], options.get("feed", "bars"), columns, overwrite

    def write(self, rows: Iterator[Row]) -> Staged:
        sink, token, n = made(self.sink), uuid.uuid4().hex, 0

        def counted():
            nonlocal n
            for row in rows:
                n += 1
                yield dict(zip(self.columns, row))

        try:
            sink.stage(self.feed, token, counted())
        except BaseException:
            sink.discard(self.feed, [token])
            raise
        return Staged(token, n)

    def commit(self, messages: list[Staged | None]) -> None:
        made(self.sink).publish(self.feed, [m.token for m in messages if m is not None and m.rows], self.overwrite)
        self.abort([m for m in messages if m is not None and not m.rows])

    def abort(self, messages: list[Staged | None]) -> None:
        made(self.sink).discard(self.feed, [m.token for m in messages if m is not None])


class FolderSink:
    """Feeds as JSON lines in a folder that all executors reach: staged files lie beside the published ones under a
    hidden name, and publishing renames them."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _file(self, feed: str, token: str, staged: bool) -> Path:
        return self.folder / feed / f"{'.' if staged else ''}{token}.jsonl"

    def stage(self, feed: str, token: str, rows: Iterator[dict]) -> None:
        (self.folder / feed).mkdir(parents=True, exist_ok=True)
        with self._file(feed, token, True).open("w") as f:
            for row in rows:
                f.write(json.dumps(row, default=str) + "\n")

    def publish(self, feed: str, tokens: list[str], overwrite: bool) -> None:
        (self.folder / feed).mkdir(parents=True, exist_ok=True)
        old = list((self.folder / feed).glob("[!.]*.jsonl")) if overwrite else []
        for token in tokens:
            self._file(feed, token, True).rename(self._file(feed, token, False))
        for f in old:
            f.unlink()

    def discard(self, feed: str, tokens: list[str]) -> None:
        for token in tokens:
            self._file(feed, token, True).unlink(missing_ok=True)


class VendorSource(DataSource):
    """Options: ``feed`` (see SCHEMAS); to read, ``source`` (module:factory of a PriceSource) and ``symbols`` (comma-joined);
    to write, ``sink`` (module:factory of a sink such as :class:`FolderSink`)."""

    @classmethod
    def name(cls):
        return "vendor"

    def schema(self):
        return SCHEMAS[self.options.get("feed", "bars")]

    def reader(self, schema):
        return VendorReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite):
        return VendorWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``vendor`` known to the session, and let it push filters to sources written in Python."""
    spark.dataSource.register(VendorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def news_item(raw: Column) -> Column:
    """Struct ``title, publisher, published`` of a vendor's JSON news item, nested under ``content`` or flat."""
    first = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])
    seconds = F.timestamp_seconds(F.get_json_object(raw, "$.providerPublishTime").cast("bigint"))
    return F.struct(
        first("$.content.title", "$.title").alias("title"), first("$.content.provider.displayName", "$.publisher").alias("publisher"),
        F.coalesce(F.try_to_timestamp(F.get_json_object(raw, "$.content.pubDate")), seconds).alias("published"),
    )
