"""The vendor data source: what it fetches under filters, and what a write leaves."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import vendor

DAY = dt.date(2024, 1, 1)
LOG = "/tmp/tidemark-vendor-calls"


class Feed:
    """Tells each fetch in a file, as it runs in other processes."""

    def _told(self, *call):
        with open(os.environ.get("VENDOR_CALLS", LOG), "a") as f:
            f.write(json.dumps(call, default=str) + "\n")

    def bars(self, symbol, since=None, until=None):
        self._told("bars", symbol, since, until)
        for k in range(100):
            day = DAY + dt.timedelta(days=k)
            if (since is None or day >= since) and (until is None or day <= until):
                yield {"date": day, "Close": float("nan") if k == 50 else 1.0 * k, "Adj Close": 0.5 * k, "Volume": k}

    def news(self, symbol):
        self._told("news", symbol)
        return [{"title": f"{symbol} {h}", "published": dt.datetime(2024, 1, 1, h)} for h in (1, 5, 9)]

    def meta(self, symbol):
        return [{"sector": "Tech", "name": symbol.lower()}]

    def ownership(self, symbol):
        return [{"held_pct_institutions": float("nan"), "n_institutions": 3, "snapshot_at": dt.datetime(2024, 1, 2)}]


class Broken:
    def bars(self, symbol):
        yield {"date": DAY, "close": 1.0}
        raise OSError("no line")


def sink():
    return vendor.FolderSink(os.environ.get("VENDOR_SINK", LOG + "-sink"))


class HalfBroken(vendor.FolderSink):
    """Fails in the task that meets symbol C."""

    def __init__(self):
        super().__init__(LOG + "-sink")

    def stage(self, feed, token, rows):
        def checked():
            for r in rows:
                if r["symbol"] == "C":
                    raise OSError("disk full")
                yield r

        super().stage(feed, token, checked())


def read(spark, feed, source="Feed", symbols="A, B,C,A"):
    options = {"source": f"tests.test_vendor:{source}", "symbols": symbols, "feed": feed}
    return spark.read.format("vendor").options(**options).load()


def calls():
    with open(LOG) as f:
        return sorted(map(json.loads, f))


@pytest.fixture
def clean(spark):
    vendor.register(spark)
    for path in [LOG, *(os.path.join(d, f) for d, _, fs in os.walk(LOG + "-sink") for f in fs)]:
        if os.path.exists(path):
            os.unlink(path)


def test_filters_prune_what_is_fetched(spark, clean):
    bars = read(spark, "bars")
    found = bars.where("symbol = 'B' and date >= '2024-02-01' and date < '2024-02-04'").collect()
    assert sorted((r.symbol, r.date.day, r.close, r.adj_close, r.volume) for r in found) == [("B", d, 30.0 + d, (30.0 + d) / 2, 30 + d) for d in (1, 2, 3)]
    assert calls() == [["bars", "B", "2024-02-01", "2024-02-04"]]
    os.unlink(LOG)
    assert bars.where(F.col("symbol").isin("A", "C", "Z")).count() == 198 and [c[1] for c in calls()] == ["A", "C"]
    os.unlink(LOG)
    assert read(spark, "news").where("published > timestamp'2024-01-01 04:00:00' and symbol in ('A', 'B')").count() == 4
    assert [c[:2] for c in calls()] == [["news", "A"], ["news", "B"]]
    os.unlink(LOG)
    assert bars.where("symbol = 'Z'").count() == 0 and not os.path.exists(LOG)
    assert bars.where("close > 97 and symbol <> 'A'").count() == 4


def test_meta_and_ownership(spark, clean):
    assert sorted((r.symbol, r.sector, r.industry, r.name) for r in read(spark, "meta").collect()) == [(s, "Tech", None, s.lower()) for s in "ABC"]
    r = read(spark, "ownership", symbols="A").first()
    assert (r.held_pct_institutions, r.n_institutions, r.snapshot_at) == (None, 3, dt.datetime(2024, 1, 2))


def rows_in_sink():
    out = []
    for d, _, fs in os.walk(LOG + "-sink"):
        for f in fs:
            with open(os.path.join(d, f)) as lines:
                out += [(f.startswith("."), json.loads(x)["symbol"]) for x in lines]
    return sorted(out)


def test_writes_are_published_whole_or_not_at_all(spark, clean):
    rows = spark.createDataFrame([(s, "Tech", None, s.lower()) for s in "AABB"], vendor.SCHEMAS["meta"]).repartition(3)
    write = lambda df, mode, to="sink": df.write.format("vendor").option("sink", f"tests.test_vendor:{to}").option("feed", "meta").mode(mode).save()
    write(rows, "append")
    assert rows_in_sink() == [(False, "A")] * 2 + [(False, "B")] * 2
    write(rows.limit(1), "append")
    assert len(rows_in_sink()) == 5
    broken = spark.createDataFrame([(s, None, None, None) for s in "ABCD"], vendor.SCHEMAS["meta"]).repartition(4, "symbol")
    with pytest.raises(Exception, match="disk full"):
        write(broken, "append", "HalfBroken")
    assert len(rows_in_sink()) == 5 and not any(hidden for hidden, _ in rows_in_sink())
    write(rows.where("symbol = 'B'"), "overwrite")
    assert rows_in_sink() == [(False, "B")] * 2
    with pytest.raises(Exception, match="no line"):
        read(spark, "bars", "Broken").count()
