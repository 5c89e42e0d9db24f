"""Exact top-k inner-product search by pivot-table elimination.

Distances of every vector to many pivots are computed once. For a query q and a vector x, the largest gap between
their distances to a pivot bounds |q - x| from below and so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 from above.
Candidates are evaluated in the order of this bound until it falls below the k-th best score. Pivots are rows of the
table: a query's scores with them give a first k-th best score, which holds for each block of candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

K = 5
QUERY_EVERY = 50
SCALE = 256
PIVOTS = 32
#: Pivots are chosen among so many rows, each as far as can be from those before.
PIVOT_SAMPLE = 512
#: Rows of a block of candidates: at most, and at least where that makes more tasks.
CANDIDATE_BLOCK = 16384
LEAST_BLOCK = 2048
QUERY_BLOCK = 8192
#: Candidates evaluated before the first look at the bound; twice as many before each later one.
STRIDE = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components floor(scale * x), x as double. Vectors that are null or hold a null or non-finite
    component are left out, and so are rows with a null id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v,
        lambda x: F.floor(x * scale)).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = m.astype(np.float64)
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots.astype(np.float64)], axis=1)) if len(pivots) else np.zeros((len(m), 0))


def farthest_first(m: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``m``, the first one and then each the farthest from those before; equal rows only once."""
    x = m.astype(np.float64)
    chosen, gap = [], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        k = int(gap.argmax())
        if not gap[k]:
            break
        chosen.append(k)
        gap = np.minimum(gap, ((x - x[k]) ** 2).sum(axis=1))
    return m[chosen]


class Candidates:
    """A block of candidates: ids, vectors and their distances to the pivots; norms are taken once."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, far: np.ndarray):
        self.ids, self.m, self.far = ids, m, far
        self.norms = (m.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(np.abs(m).max(initial=0)) * max(1, m.shape[1])
        self.single, self.double = m.astype(np.float32) if self.top < 2**24 else None, None

    def dot(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integer inner products of some rows: by floating point where no sum can leave its bits."""
        top = self.top * float(np.abs(q).max(initial=0))
        if top < 2**24 and self.single is not None:
            return (self.single[at] @ q.astype(np.float32)).astype(np.int64)
        if top < 2**52:
            self.double = self.m.astype(np.float64) if self.double is None else self.double
            return (self.double[at] @ q.astype(np.float64)).astype(np.int64)
        return self.m[at] @ q

    def search(self, q_id: int, q: np.ndarray, q_far: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """``(vec_id, score, candidates evaluated)``: of the ``k`` best rows for a query, ties to smaller ids, those
        that score ``least`` or more."""
        gap = np.abs(self.far - q_far).max(axis=1) if self.far.shape[1] else np.zeros(len(self.ids))
        norms = self.norms + float((q.astype(np.float64) ** 2).sum())
        bound = (norms - gap**2) / 2 + 1e-9 * norms + 1e-6
        slack = least if np.isinf(least) else least - 1e-9 * abs(least)
        left = np.flatnonzero((bound >= slack) & (self.ids != q_id))
        best_id, best, seen, stride = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STRIDE
        while len(left):
            if len(left) > stride:
                cut = np.argpartition(-bound[left], stride)
                part, left = left[cut[:stride]], left[cut[stride:]]
            else:
                part, left = left, left[:0]
            all_id, all_score = np.concatenate([best_id, self.ids[part]]), np.concatenate([best, self.dot(part, q)])
            if len(all_id) > k:
                near = all_score >= np.partition(all_score, -k)[-k]
                all_id, all_score = all_id[near], all_score[near]
            top = np.lexsort((all_id, -all_score))[:k]
            best_id, best, seen, stride = all_id[top], all_score[top], seen + len(part), 2 * stride
            if len(best) == k:
                left = left[bound[left] >= best[-1]]
        fine = best >= slack
        return best_id[fine], best[fine], seen


def _blocks(rows: DataFrame, n_rows: int, size: int, width: int, pivots: np.ndarray, name: str) -> DataFrame:
    n = max(1, -(-n_rows // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = _matrix(pdf["v"].tolist(), width)
        narrow = bool(np.abs(m).max(initial=0) < 1 << 31)
        return pd.DataFrame({name: pdf["block"].iloc[:1], f"{name}_narrow": [narrow],
            f"{name}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                f"{name}_m": [m.astype(np.int32 if narrow else np.int64).tobytes()], f"{name}_far": [_distances(m, pivots).tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, f"{name} int, {name}_narrow boolean, {name}_ids binary, {name}_m binary, {name}_far binary")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_every: int = QUERY_EVERY,
    n_pivots: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``query_every``, its ``k`` highest
    integer inner products with all other rows; fewer rows give fewer results.

    Rows under the query's own id are never its results; of rows that repeat a query id one asks, the others stay
    candidates of other queries. Equal scores go by smaller ids. Vectors of unequal lengths count as padded with zeros.
    An empty table gives no rows. Other columns are not read. Queries and candidates meet block by block: each block of queries is dealt to each block of candidates.
    """
    rows = written(quantised(vectors, id_col, vector_col), "topk-vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    queries = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"])
    n_queries = queries.count()
    width = max(1, width or 0)
    some = _matrix([r.v for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(PIVOT_SAMPLE).collect()], width)
    pivots = farthest_first(some, n_pivots)
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    size = min(candidate_block, max(LEAST_BLOCK, -(-n // tasks)))
    n_c, n_q = max(1, -(-n // size)), max(1, -(-n_queries // query_block))
    bound_arrow_batches(rows.sparkSession)
    c = _blocks(rows, n, size, width, pivots, "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = _blocks(queries, n_queries, query_block, width, pivots, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    pairs = c.join(q.hint("merge"), ["c", "q"]).drop("c", "q")
    n_p = len(pivots)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                side = {}
                for s in ("c", "q"):
                    kind = np.int32 if row[f"{s}_narrow"] else np.int64
                    side[s] = (np.frombuffer(row[f"{s}_ids"], np.int64), np.frombuffer(row[f"{s}_m"], kind).astype(np.int64).reshape(-1,
                        width), np.frombuffer(row[f"{s}_far"], np.float64).reshape(-1, n_p))
                block, of_pivots = Candidates(*side["c"]), Candidates(np.arange(n_p), pivots, np.zeros((n_p, 0)))
                out_q, out_id, out_score = [], [], []
                for q_id, q_v, q_far in zip(*side["q"]):
                    # Distinct rows, so k + 1 of them hold k that aren't the query's own.
                    known = np.sort(of_pivots.dot(np.arange(n_p), q_v)) if n_p > k else []
                    least = float(known[-k - 1]) if len(known) else -np.inf
                    found, score, _ = block.search(int(q_id), q_v, q_far, k, least)
                    out_q.append(np.full(len(found), q_id))
                    out_id.append(found)
                    out_score.append(score)
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_id, out_score)], ["query_id",
                    "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
