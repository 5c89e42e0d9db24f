"""Connected components of a graph given by its edges, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, written


def _star(edges: DataFrame, both: bool, label: str) -> DataFrame:
    """Tie each neighbour to the smallest of its star: larger neighbours (``both``) or smaller ones."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = near.where("a <> b")
    smallest = written(near.groupBy("a").agg(F.min("b").alias("m")), f"{label}-least")
    least = smallest.withColumn("m", F.least("a", "m"))
    tied = near.join(least.hint("merge"), "a")
    if both:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = written(out.where("a <> b").distinct(), label)
    release(smallest, edges)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` (columns ``a, b``, long) can reach.

    Alternating large-star and small-star rounds; the neighbours of a hub are joined to one row, so its share of
    the rows can be split. Nulls and loops are ignored; a node without another one has no row; no edges, no rows.
    Rounds grow with the logarithm of a component's diameter, and go on until nothing changes.
    """
    edges = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    before, step = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, step = now, step + 1
        edges = _star(_star(edges, True, f"large-star-{step}"), False, f"small-star-{step}")
