"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, each to the
least-loaded shard through a heap."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

SHARDS = 16
#: Sub-buckets of a size class and of a shard: ranks are counted in each, then offset, so that no window holds a whole class.
BUCKETS = 4096
#: Sizes that the driver plans with, at most. All sizes are planned by as many leading bits as can't give more.
MAX_SIZES = 1 << 18


def leading_bits(max_sizes: int) -> int:
    """Leading bits by which no more than ``max_sizes`` sizes of 63 bits are told apart: 13 for MAX_SIZES; one at least."""
    bits = 1
    while 2 ** (bits + 1) + 2**bits * (62 - bits) <= max_sizes:
        bits += 1
    return bits


def lpt_runs(histogram: list[tuple[int, int]], shards: int = SHARDS) -> dict[int, list[int]]:
    """Longest-processing-time over ``(size, groups of that size)``: for each size, how many groups go to each shard.

    Equal sizes are interchangeable, so a run of c equal groups needs no c heap steps: all but the last few are
    placed at once at the highest common level that they fill for certain, the rest one by one through the heap.
    The loads are the same as those of the plain heap.
    """
    heap = [(0, s) for s in range(shards)]
    plan: dict[int, list[int]] = {}
    for size, count in sorted(histogram, reverse=True):
        counts = [0] * shards
        if count > 4 * shards and size > 0:
            loads = dict((s, load) for load, s in heap)
            lo, hi = min(loads.values()), max(loads.values()) + size * count
            while hi - lo > 1:  # the highest level below which at most `count` groups start
                mid = (lo + hi) // 2
                started = sum(max(0, -(-(mid - load) // size)) for load in loads.values())
                lo, hi = (mid, hi) if started <= count else (lo, mid)
            for s, load in loads.items():
                counts[s] = max(0, -(-(lo - load) // size))
            heap = [(loads[s] + counts[s] * size, s) for s in range(shards)]
            heapq.heapify(heap)
        for _ in range(count - sum(counts)):
            load, s = heapq.heappop(heap)
            counts[s] += 1
            heapq.heappush(heap, (load + size, s))
        plan[size] = counts
    return plan


def _rank_within(df: DataFrame, keys: list[str], order: list[str], spread: list[str], out: str, buckets: int) -> DataFrame:
    """Add ``out``: 0-based rank within ``keys``, by bucket of ``spread`` and then ``order``. Counts of a bucket are
    pre-aggregated and summed up over at most ``buckets`` rows a key; the rows themselves are only sorted by bucket."""
    df = df.withColumn("__b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) - 1
    return df.withColumn("__r", local).join(starts, [*keys, "__b"]).withColumn(out,
        (F.col("__start") + F.col("__r")).cast("long")).drop("__b", "__r", "__start")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, buckets: int = BUCKETS,
    max_sizes: int = MAX_SIZES) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards' sizes are near equal. ``size`` is the text's UTF-8 bytes plus 1; rows with equal
    texts are one group and share a shard; null text counts as empty. ``slot`` counts 0, 1, ... in each shard;
    ``grown_shard`` is null, as the law asks for. Repeated rows each take a slot, and rows of one id, null among them,
    are spread by their texts; groups of equal size are told apart by their digests. An empty table gives no rows, and
    other columns are not read.

    Only a histogram of group sizes reaches the driver. Groups are always planned by the leading bits of their size, 13
    for the usual ``max_sizes``: sizes under 8,192 as they are, larger ones cut by one part in 4,096 at most, so loads are
    off by no more. How a group is placed depends on sizes alone, not on how many there are. Texts never move: groups are
    keyed by their SHA-256.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("gsize")), "shard-groups")
    low = F.greatest(F.length(F.bin("gsize")) - leading_bits(max_sizes), F.lit(0))
    groups = groups.withColumn("gsize", F.col("gsize").bitwiseAND(-F.pow(F.lit(2), low).cast("long")))
    histogram = [(r.gsize, r.n) for r in groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = []
    for size, counts in lpt_runs(histogram, shards).items():
        total, ends = 0, []
        for c in counts:
            total += c
            ends.append(total)
        bounds.append((size, ends))
    schema = T.StructType([T.StructField("gsize", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    plan = rows.sparkSession.createDataFrame(bounds, schema)
    ranked = _rank_within(groups, ["gsize"], ["digest"], ["digest"], "rank", buckets).join(plan, "gsize")
    placed = written(ranked.select("digest", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")), "shard-placed")
    sharded = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard")
    out = _rank_within(written(sharded, "shard-out"), ["shard"], ["doc_id", "text_crc32"], ["doc_id", "text_crc32", "size"], "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
