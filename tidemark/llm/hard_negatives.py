"""Hard-negative mining by a vector-approximation file.

Each dimension is cut into cells at quantiles of a bounded sample. The file holds the rows in blocks: a cell number of
one byte for each component, the least and greatest value that the block has in each cell, and the vectors themselves.
For an anchor, a table of its component times those two values gives a lower and an upper bound of every row's inner
product by look-ups alone; only rows whose bounds allow them into a window, and among its best, are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: A window holds scores from LOW to HIGH percent of the positive's.
LOW, HIGH = 30, 90
CELLS = 64
#: Cell borders are quantiles of so many rows. Bounds hold for all rows, whatever the sample.
BORDER_SAMPLE = 4096
#: Rows of a block of the file: at most, and at least where that makes more tasks.
FILE_BLOCK, LEAST_BLOCK = 16384, 2048
ANCHOR_BLOCK = 1024
#: Anchors whose bounds are held at once.
LANE = 32

FILE = "c int, ids binary, labels binary, codes binary, low binary, high binary, m binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: rows with an id, a label and a vector of finite components, as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & fine
    return vectors.where(some).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, padded with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def borders(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Inner cell borders of each dimension: quantiles of the sample."""
    if not len(sample):
        return np.zeros((cells - 1, sample.shape[1]))
    return np.quantile(sample, np.arange(1, cells) / cells, axis=0)


def approximate(m: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``codes`` (a row for each dimension) and the least and greatest value of each dimension's cells among the rows."""
    width, cells = m.shape[1], len(cut) + 1
    codes = np.zeros((width, len(m)), np.uint8)
    low, high = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
    for d in range(width):
        codes[d] = np.searchsorted(cut[:, d], m[:, d], side="right")
        order = np.argsort(codes[d], kind="stable")
        held, first = np.unique(codes[d][order], return_index=True)
        if len(held):
            low[d, held], high[d, held] = np.minimum.reduceat(m[order, d], first), np.maximum.reduceat(m[order, d], first)
    return codes, low, high


class VectorFile:
    """A block of the file. Rows lie by label."""

    def __init__(self, ids, labels, codes, low, high, m):
        self.ids, self.labels, self.codes, self.low, self.high, self.m = ids, labels, codes, low, high, m
        self.top = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * max(1, m.shape[1])
        self.real: dict = {}

    @classmethod
    def of(cls, row: dict, width: int) -> VectorFile:
        ids = np.frombuffer(row["ids"], np.int64)
        n, m = len(ids), row["m"]
        m = np.frombuffer(m, np.int32 if len(m) == 4 * n * width else np.int64).reshape(n, width)
        low, high = (np.frombuffer(row[k], np.int64).reshape(width, -1) for k in ("low", "high"))
        return cls(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["codes"], np.uint8).reshape(width, n), low, high, m)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def bounds(self, q: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of some rows (down) with anchors (across), by table look-up.
        Sums that single precision can't hold exactly are taken in double precision and widened."""
        top = self.top * float(np.abs(q).max(initial=0))
        kind = np.float32 if top < 2**24 else np.float64
        n = len(self.ids[part])
        least, most = np.zeros((n, len(q)), kind), np.zeros((n, len(q)), kind)
        for d in range(q.shape[1]):
            a, b = (np.multiply.outer(x[d].astype(np.float64), q[:, d].astype(np.float64)) for x in (self.low, self.high))
            code = self.codes[d, part]
            least += np.minimum(a, b).astype(kind)[code]
            most += np.maximum(a, b).astype(kind)[code]
        slack = 0 if top < 2**52 else top * 1e-12 * max(1, q.shape[1])
        return least - kind(slack), most + kind(slack)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: by floating point where no sum can leave its bits."""
        top = self.top * float(np.abs(q).max(initial=0))
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**52 else np.int64
        if kind not in self.real:
            self.real[kind] = self.m.astype(kind)
        return (self.real[kind][at] @ q.astype(kind)).astype(np.int64)

    def best(self, q: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, low: float = -math.inf,
        high: float = math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """``(rows, scores, rows scored)``: of the allowed rows that score from ``low`` to ``high`` the ``k`` best."""
        may = allowed & (most >= low) & (least <= high)
        sure = np.flatnonzero(may & (least >= low) & (most <= high))
        if len(sure) >= k:
            may &= most >= np.partition(least[sure], -k)[-k]
        at = np.flatnonzero(may)
        score = self.scores(at, q) if len(at) else np.zeros(0, np.int64)
        fine = (score >= low) & (score <= high)
        rows, score, seen = at[fine], score[fine], len(at)
        if len(rows) > k:
            near = score >= np.partition(score, -k)[-k]
            rows, score = rows[near], score[near]
        first = np.lexsort((self.ids[rows], -score))[:k]
        return rows[first], score[first], seen


def vector_file(rows: DataFrame, n: int, width: int, cut: np.ndarray, block: int) -> DataFrame:
    """The file: ``rows`` (``vec_id, label, v, rid``) in blocks dealt by row number, so that no id or label makes a
    large one."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "vec_id", "rid"])
        m = matrix(pdf["v"].tolist(), width)
        codes, low, high = approximate(m, cut)
        narrow = bool(np.abs(m).max(initial=0) < 1 << 31)
        ids, labels = (pdf[x].to_numpy(np.int64).tobytes() for x in ("vec_id", "label"))
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "ids": [ids], "labels": [labels], "codes": [codes.tobytes()], "low": [low.tobytes()],
            "high": [high.tobytes()], "m": [m.astype(np.int32 if narrow else np.int64).tobytes()]})

    dealt = rows.withColumn("c", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n // block)))).cast("int"))
    return dealt.groupBy("c").applyInPandas(pack, FILE)


def _meet(file: DataFrame, n_blocks: int, asks: DataFrame, n_asks: int, block: int, search, schema: str) -> DataFrame:
    """Each block of anchors meets each block of the file. ``asks``: ``anchor_id, label, v`` and, in ``windows``, what
    ``search(file block, label, [(id, vector, windows)])`` needs; it gives columns of ``schema``."""
    n_q = max(1, -(-n_asks // block))
    packed = asks.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(n_q)).cast("int").alias("q")).agg(F.collect_list(F.struct("label",
        "anchor_id", "v", "windows")).alias("asks"))
    left = file.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = packed.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = len(row["low"]) // 8 // CELLS
                held, by_label = VectorFile.of(row, width), {}
                for a in sorted(row["asks"], key=lambda x: (x["label"], x["anchor_id"])):
                    by_label.setdefault(a["label"], []).append(a)
                for label, some in by_label.items():
                    for i in range(0, len(some), LANE):
                        lane = some[i : i + LANE]
                        found = search(held, label, lane, matrix([a["v"] for a in lane], width))
                        if found:
                            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names)

    return left.join(right.hint("merge"), ["c", "q"]).drop("c", "q").mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    file_block: int = FILE_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_every``; an anchor's positives its ``positives`` best other rows of
    its label; a positive's negatives the ``negatives`` best rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's. Scores are integer inner products, ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Rows under the anchor's own id
    are never its positives or negatives; of rows that repeat an anchor's id the one with the smallest label and vector
    asks; other repeated rows are rows of their own, and a positive that is there twice has its negatives twice.
    Vectors of unequal lengths count as padded with zeros; inner products must fit into 64 bits. An anchor without a
    positive, and a positive with a score below zero, has no rows; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    numbered = usable(vectors, id_col, vector_col, label_col).withColumn("rid", F.monotonically_increasing_id())
    rows = written(numbered, "negatives-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    sample = rows.orderBy(F.xxhash64("rid"), "rid").select("v").limit(BORDER_SAMPLE).collect()
    cut = borders(matrix([r.v for r in sample], width))
    block = min(file_block, max(LEAST_BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    n_blocks = max(1, -(-n // block))
    file = written(vector_file(rows, n, width, cut, block), "negatives-file")
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(one)
    anchors = anchors.select("anchor_id", "one.label", "one.v")
    n_anchors = anchors.count()

    def nearest(held: VectorFile, label: int, lane: list, q: np.ndarray) -> list:
        part, out = held.of_label(label), []
        least, most = held.bounds(q, part)
        for j, a in enumerate(lane):
            allowed = np.zeros(len(held.ids), bool)
            allowed[part] = held.ids[part] != a["anchor_id"]
            full_least, full_most = np.zeros(len(held.ids), least.dtype), np.zeros(len(held.ids), most.dtype)
            full_least[part], full_most[part] = least[:, j], most[:, j]
            at, score, _ = held.best(q[j], allowed, full_least, full_most, positives)
            out += [(a["anchor_id"], int(held.ids[i]), int(s)) for i, s in zip(at, score)]
        return out

    def in_windows(held: VectorFile, label: int, lane: list, q: np.ndarray) -> list:
        least, most = held.bounds(q, slice(0, len(held.ids)))
        other, out = held.labels != label, []
        for j, a in enumerate(lane):
            allowed, up, down = other & (held.ids != a["anchor_id"]), np.ascontiguousarray(most[:, j]), np.ascontiguousarray(least[:, j])
            for w in a["windows"]:
                bottom, top = -(-low * w["score"] // 100), high * w["score"] // 100
                if bottom <= top:
                    at, score, _ = held.best(q[j], allowed, down, up, negatives, bottom, top)
                    out += [(a["anchor_id"], w["slot"], w["positive_id"], w["score"], int(held.ids[i]), int(s)) for i, s in zip(at, score)]
        return out

    asks = anchors.withColumn("windows", F.lit(None).cast("array<struct<slot:int,positive_id:long,score:long>>"))
    found = _meet(file, n_blocks, asks, n_anchors, anchor_block, nearest, "anchor_id long, positive_id long, score long")
    slot = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    pairs = written(found.withColumn("slot", slot).where(F.col("slot") <= positives), "negatives-positives")
    windows = pairs.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_id", "score"))).alias("windows"))
    asks = anchors.join(windows.hint("merge"), "anchor_id")
    mined = _meet(file, n_blocks, asks, n_anchors, anchor_block, in_windows,
        "anchor_id long, slot long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank",
        "negative_id", "positive_score", "negative_score")
