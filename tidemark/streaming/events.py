"""Structured streaming over timed events: windows, sessions, and the restatement log as change capture."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; event time as a timestamp, which watermarks ask for."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n", "total")


def drained(df: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a streaming table over what is there now and give its rows: those of the last batch that changed a row of a
    complete or updated result. They are kept as files under ``folder``, one part for each batch; none pass the driver."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    q = df.writeStream.foreachBatch(batch).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress.batchId if q.lastProgress is not None else 0
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/epoch={last}")


# The restatement log

#: Times in microseconds: state gives timestamps back without a zone.
LAST = "close double, adj_close double, volume bigint, seen bigint"
LOG = "symbol string, date date, " + LAST
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def near(a: float | None, b: float | None) -> bool:
    """Whether two values are the same but for 1e-9 of themselves; so are two that are missing."""
    return a is None and b is None or (a is not None and b is not None and abs(a - b) <= max(max(abs(a), abs(b)) * 1e-9, 1e-12))


class LastBar(StatefulProcessor):
    """The last known bar of a cell (symbol, date). A row goes to the log if it was seen after that bar and differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("bar", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r.seen):
            if known is not None and r.seen <= known[3]:
                continue
            same = known is not None and near(r.close, known[0]) and near(r.adj_close, known[1]) and r.volume == known[2]
            known = (*known[:3], r.seen) if same else (r.close, r.adj_close, r.volume, r.seen)
            if not same:
                yield Row(symbol=key[0], date=key[1], close=r.close, adj_close=r.adj_close, volume=r.volume, seen=r.seen)
        if known is not None:
            self.last.update(known)

    def close(self) -> None:
        pass


def restatements(bars: DataFrame) -> DataFrame:
    """The bars of a stream (``symbol, date, close, adj_close, volume, seen_at``) that are new or restated: a price moved
    by over 1e-9 of itself, or the volume at all. State holds each cell's last bar, so a batch costs what its rows cost,
    however long the log is. Rows seen no later than the cell's last one - replays and late rows - tell nothing, so
    the log doesn't depend on how often they come or how rows fall into batches. Rows without a key or a time are left
    out; of rows of one cell with equal times in one batch any may count."""
    there = bars.where("symbol is not null and date is not null and seen_at is not null").withColumn("seen", F.unix_micros("seen_at"))
    log = there.select("symbol", "date", "close", "adj_close", "volume", "seen").groupBy("symbol", "date").transformWithState(LastBar(), LOG,
        "append", "none")
    return log.withColumn("seen_at", F.timestamp_micros("seen")).drop("seen")


def restatement_log(bars: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """A query that appends :func:`restatements` to the Parquet log under ``log_path``, each row once, also after a restart.
    Keyed state needs the RocksDB store; the session's own choice of a store is left as it was."""
    conf, key = bars.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:
        rows = restatements(bars).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return rows.trigger(availableNow=True).start(log_path)
    finally:
        conf.set(key, before)
