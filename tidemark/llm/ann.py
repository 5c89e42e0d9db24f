"""Approximate nearest neighbours by cosine, through an inverted multi-index.

Vectors of length one are cut into two halves, and each half has a codebook of its own. A row lies in the cell that the
nearest centroids of its two halves name. A query walks the pairs of centroids in the order of their summed distances,
with a heap over the two sorted lists, until the cells it has met hold enough rows; those are scored exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

K = 5
QUERY_EVERY = 50
#: Centroids of a half: CODES ** 2 cells.
CODES = 64
#: Codebooks, and the share of rows to meet, are fitted on so many rows; every row is in the index.
FIT_ROWS, FIT_QUERIES = 4096, 256
ROUNDS = 10
#: Share of the sample's true neighbours that a walk should meet.
AIM = 0.98
#: A walk meets so many rows at least.
LEAST_ROWS = 64
ENTRY_BLOCK, LEAST_BLOCK = 16384, 2048
QUERY_PACK = 512

ENTRIES = "block int, ids binary, cells binary, m binary"
ASKS = "block int, q_ids binary, q_m binary, q_cells binary, q_ends binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite components that aren't all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)
    return vectors.where(some).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros, each scaled by a power of two to components below one: no cosine changes,
    and no square leaves the range of doubles."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    _, power = np.frexp(np.abs(out).max(axis=1, initial=0))
    return np.ldexp(out, -power[:, None])


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less the rows' own squares."""
    return (c * c).sum(axis=1) - 2 * x @ c.T


def codebook(x: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``x`` by k-means, started from rows far from each other among equally spaced ones; ``codes`` at most."""
    x = np.unique(x, axis=0)
    if len(x) <= codes:
        return x
    c = x[np.linspace(0, len(x) - 1, codes).astype(int)]
    for _ in range(rounds):
        near = squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells (first * len(second) + second) that are not empty, in the order of their summed distances, until they hold
    ``wanted`` rows or none are left. ``held``: rows of each cell."""
    a, b, width = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap, out, met, reached = [(x[0] + y[0], 0, 0)], [], 0, [0] * len(x)
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if n := int(held[cell]):
            out.append(cell)
            met += n
        reached[i] = j + 1
        # A pair enters once both its neighbours towards the start have left.
        if j + 1 < width and (i == 0 or reached[i - 1] >= j + 2):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return out


class MultiIndex:
    """Two codebooks and the share of rows that a walk should meet."""

    def __init__(self, sample: np.ndarray, k: int = K, codes: int = CODES, aim: float = AIM):
        self.half, x = max(1, sample.shape[1] // 2), unit(sample)
        self.first, self.second = codebook(x[:, : self.half], codes), codebook(x[:, self.half :], codes)
        self.share = self.fitted_share(x, k, aim)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of length one."""
        i, j = squares(x[:, : self.half], self.first).argmin(axis=1), squares(x[:, self.half :], self.second).argmin(axis=1)
        return i * len(self.second) + j

    def walk(self, q: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
        return walk(squares(q[None, : self.half], self.first)[0], squares(q[None, self.half :], self.second)[0], held, wanted)

    def fitted_share(self, x: np.ndarray, k: int, aim: float) -> float:
        """Share of the sample's rows after which walks have met the share ``aim`` of their true neighbours."""
        cells, n = self.cells(x), len(x)
        held, needed = np.bincount(cells, minlength=len(self.first) * len(self.second)), []
        for i in range(min(n, FIT_QUERIES)):
            near = x @ x[i]
            near[i] = -np.inf
            true = np.argsort(-near, kind="stable")[: min(k, n - 1)]
            order = self.walk(x[i], held, n)
            met = dict(zip(order, np.cumsum(held[order])))
            needed += [met[c] for c in cells[true]]
        return float(np.quantile(needed, aim, method="higher")) / n if needed else 1.0


def cosines(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with a query, each row by the same steps wherever it lies, so equal vectors score alike."""
    return (m * q).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * math.sqrt(float((q * q).sum())))


def nearest(ids: np.ndarray, m: np.ndarray, length: np.ndarray, q_id: int, q: np.ndarray, at: np.ndarray, k: int):
    """Ids and cosines of the ``k`` nearest of the rows ``at`` that don't have the query's id."""
    at = at[ids[at] != q_id]
    if len(at) > k:
        near = length[at] @ (q / math.sqrt(float((q * q).sum())))
        at = at[near >= np.partition(near, -k)[-k] - 1e-9]
    score = cosines(m[at], q)
    first = np.lexsort((ids[at], -score))[:k]
    return ids[at][first], score[first]


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    query_every: int = QUERY_EVERY, codes: int = CODES, share: float | None = None, entry_block: int = ENTRY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``query_every``, the ``k`` nearest rows
    found, by the cosine of the original vectors in double precision, ties to smaller ids.

    A walk meets at least the ``share`` of all rows (None: as fitted on the sample, so that 0.98 of the sample's true
    neighbours are met) and LEAST_ROWS rows, so tables of up to that many rows are searched whole.

    Rows with a null id or vector, a null or non-finite component, or only zeros take no part. Rows under the query's
    own id are never its results; of rows that repeat a query's id the one with the smallest vector asks, the others stay
    candidates of other queries. Vectors of unequal lengths count as padded with zeros. An empty table gives no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    rows = usable(vectors, id_col, vector_col).withColumn("rid", F.monotonically_increasing_id())
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = MultiIndex(matrix([r.v for r in rows.orderBy(F.xxhash64("rid"), "rid").select("v").limit(FIT_ROWS).collect()], width), k, codes)
    wanted = max(LEAST_ROWS, math.ceil(n * (index.share if share is None else share))) + 1

    def assign(batches):
        for batch in batches:
            cells = index.cells(unit(matrix(batch.column("v").to_pylist(), width))) if batch.num_rows else []
            yield batch.append_column("cell", pa.array(np.asarray(cells), pa.int64()))

    entries = written(rows.mapInArrow(assign, "vec_id long, v array<double>, rid long, cell long"), "ann-entries")
    held = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in entries.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]

    # Cells go to blocks in order; one that holds more than a block is dealt to several by row number.
    block = min(entry_block, max(LEAST_BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    starts, parts, last, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, block
    for cell in np.flatnonzero(held):
        if held[cell] > room and room < block:
            last, room = last + 1, block
        starts[cell], parts[cell] = last, -(-int(held[cell]) // block)
        last, room = (last, room - int(held[cell])) if parts[cell] == 1 else (last + int(parts[cell]), block)

    def place(batches):
        for batch in batches:
            cell, rid = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "rid"))
            mixed = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = starts[cell] + (mixed % parts[cell].astype(np.uint64)).astype(np.int64)
            yield batch.append_column("block", pa.array(at.astype(np.int32)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "vec_id", "rid"])
        ids, cells = (pdf[x].to_numpy(np.int64).tobytes() for x in ("vec_id", "cell"))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [ids], "cells": [cells], "m": [matrix(pdf["v"].tolist(),
            width).tobytes()]})

    placed = entries.mapInArrow(place, "vec_id long, v array<double>, rid long, cell long, block int")
    blocks = placed.groupBy("block").applyInPandas(pack, ENTRIES)

    def ask(batches):
        """Each query's walk, packed by the blocks that it meets."""
        waiting: dict[int, list] = {}

        def packed(some):
            for b in some:
                ids, vs, cells = zip(*waiting.pop(b))
                ends = np.cumsum([len(c) for c in cells], dtype=np.int64)
                yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64),
                    np.array(vs), np.concatenate(cells).astype(np.int64), ends))], [x.split()[0] for x in ASKS.split(", ")])

        for batch in batches:
            m = matrix(batch.column("v").to_pylist(), width)
            for q_id, v, u in zip(batch.column("query_id").to_pylist(), m, unit(m) if len(m) else m):
                met = np.sort(np.array(index.walk(u, held, wanted), np.int64))
                first, end = starts[met], starts[met] + parts[met]
                for b in np.unique(np.concatenate([np.arange(x, y) for x, y in {*zip(first.tolist(), end.tolist())}])).tolist():
                    waiting.setdefault(b, []).append((q_id, v, met[(first <= b) & (b < end)]))
                yield from packed([b for b, w in waiting.items() if len(w) >= QUERY_PACK])
        yield from packed(list(waiting))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.int64)
                m, ends = np.frombuffer(row["m"]).reshape(-1, width), np.frombuffer(row["q_ends"], np.int64)
                length, asked, out = unit(m), np.frombuffer(row["q_cells"], np.int64), []
                for i, (q_id, q) in enumerate(zip(np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_m"]).reshape(-1, width))):
                    met = asked[ends[i - 1] if i else 0 : ends[i]]
                    begin, end = np.searchsorted(cells, met), np.searchsorted(cells, met, side="right")
                    at = np.concatenate([np.arange(x, y) for x, y in zip(begin, end)])
                    found, score = nearest(ids, m, length, int(q_id), q, at, k)
                    out.append((np.full(len(found), q_id), found, score))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    queries = entries.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asks = queries.mapInArrow(ask, ASKS)
    found = blocks.join(asks.hint("merge"), "block").drop("block").mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
