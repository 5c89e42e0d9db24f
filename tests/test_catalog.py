"""Queries against their SQL, and the streaming operators."""

import duckdb
import pytest

from tidemark.plans import books, flows, search  # noqa: F401  they add their queries
from tidemark.plans.catalog import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def shown(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    from tidemark.plans.catalog import QUERIES

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({ORACLE_SQL[name]})").fetchall()
    got = df.select(*cols).collect()
    assert sorted(tuple(map(shown, r)) for r in got) == sorted(tuple(map(shown, r)) for r in want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())


def test_streams(spark, tmp_path):
    from tidemark.streaming import events as s

    stream = s.read_events(spark, f"{SF}/events*.parquet")
    live = s.drained(s.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    batch = _batch(spark)
    assert sorted((r.window_start, r.event_type, r.n) for r in live.collect()) == sorted((r.window_start, r.event_type, r.n) for r in batch.collect())


def _batch(spark):
    from pyspark.sql import functions as F

    from tidemark.streaming import events as s

    return s.tumbling(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))


def test_restatement_log(spark, tmp_path):
    """A feed with replays, late and restated rows gives the same log in one batch, in many, and after restarts."""
    from tidemark.streaming import events as s

    schema = "symbol string, date string, close double, adj_close double, volume bigint, seen string"
    feeds = [
        [("A", "2024-01-01", 1.0, 1.0, 5, "2024-01-02"), ("A", "2024-01-02", 2.0, 2.0, 5, "2024-01-03"), ("B", "2024-01-01", None, 1.0, 5, "2024-01-02")],
        [("A", "2024-01-01", 1.0, 1.0, 5, "2024-02-02"), ("A", "2024-01-02", 3.0, 3.0, 5, "2024-02-03"), ("B", "2024-01-01", None, 1.0, 5, "2024-01-05")],
        [("A", "2024-01-02", 2.5, 2.5, 5, "2024-01-20"), ("A", "2024-01-02", 3.0 + 1e-12, 3.0, 5, "2024-02-05"), (None, "2024-01-02", 1.0, 1.0, 5,
            "2024-02-05")],
        [("A", "2024-01-02", 3.0, 3.0, 6, "2024-02-07"), ("A", "2024-01-02", 4.0, 3.0, 6, "2024-02-09"), ("A", "2024-01-01", 1.0, 1.0, 5, "2024-01-02")],
    ]
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def log_of(name, batches):
        src, log, at = (str(tmp_path / name / x) for x in ("in", "log", "c"))
        for rows in batches:
            spark.createDataFrame(rows, schema).selectExpr("symbol", "cast(date as date) date", "close", "adj_close", "volume",
                "cast(seen as timestamp) seen_at").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("symbol string, date date, close double, adj_close double, volume bigint, seen_at timestamp").parquet(src)
            s.restatement_log(stream, log, at).awaitTermination()
        return sorted((r.symbol, str(r.date), r.close, r.volume, str(r.seen_at)[:10]) for r in spark.read.parquet(log).collect())

    want = [("A", "2024-01-01", 1.0, 5, "2024-01-02"), ("A", "2024-01-02", 2.0, 5, "2024-01-03"), ("A", "2024-01-02", 3.0, 5, "2024-02-03"),
        ("A", "2024-01-02", 3.0, 6, "2024-02-07"), ("A", "2024-01-02", 4.0, 6, "2024-02-09"), ("B", "2024-01-01", None, 5, "2024-01-02")]
    late = ("A", "2024-01-02", 2.5, 5, "2024-01-20")
    key = lambda r: tuple(map(str, r))
    assert sorted(log_of("batches", feeds), key=key) == sorted(want, key=key)
    # In one batch the row of January 20th isn't late.
    assert sorted(log_of("one", [[r for f in feeds for r in f]]), key=key) == sorted([*want, late], key=key)
    assert sorted(log_of("replayed", [*feeds, *feeds]), key=key) == sorted(want, key=key)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept


def test_cost_of_a_batch_does_not_follow_the_log(spark, tmp_path):
    """The log is written, never read: the plan of a batch holds the feed's scan alone."""
    from tidemark.streaming import events as s

    schema = "symbol string, date date, close double, adj_close double, volume bigint, seen_at timestamp"
    src, log, at = (str(tmp_path / x) for x in ("in", "log", "c"))
    for k in range(2):
        spark.range(50).selectExpr("cast(id as string) symbol", "date'2024-01-01' date", "cast(id as double) close", "1D adj_close", "id volume",
            f"timestamp'2024-01-0{k + 1}' seen_at").coalesce(1).write.mode("append").parquet(src)
        q = s.restatement_log(spark.readStream.schema(schema).parquet(src), log, at)
        q.awaitTermination()
        assert sum(p.numInputRows for p in q.recentProgress) == 50
        assert q.recentProgress[-1].stateOperators[0].numRowsTotal >= 50 if k == 0 else spark.read.parquet(log).count() == 50
