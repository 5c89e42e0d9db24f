"""Toxicity scores by a factorization machine over hashed terms: linear weights and learned pairwise interactions."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches

#: Bound of the labelled sample that the model is fitted on: so many rows of each label, first by a hash of the id.
SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 5000
#: Terms hash to so many buckets. The model keeps every bucket whose label rates differ by MIN_Z standard errors, and
#: every word of a pair whose label rate differs by MIN_PAIR_Z from what its two words say each for itself.
HASH_BUCKETS = 1 << 22
MIN_Z = 4.0
MIN_PAIR_Z = 7.0
#: Pairs are counted in so many buckets first, then one by one in the buckets that stand out; words of pairs and pairs
#: occur in so many texts at least.
PAIR_BUCKETS = 1 << 22
MIN_PAIR_ROWS = 12
PAIR_SLICE = 1 << 18
FACTORS = 4
STEPS = 800
BATCH = 512
#: Share of a text's terms that a training step keeps: terms that always come together must each carry the decision.
#: The last steps see whole texts, so that scores are those of whole texts.
TERM_KEEP = 0.15
WHOLE_STEPS = 40
LEARNING_RATE = 0.02
L2 = 1e-4
INITIAL_FACTOR = 0.1
THRESHOLD = 0.7
#: Word stems of these lengths are terms beside whole words, as inflections share them.
STEMS = (4, 5, 6)
FOLDS, HELD_OUT_FOLD = 3, 1
CACHED_WORDS = 1 << 16

_WORD = re.compile(r"[^\W\d_]+")


def fold(id_column):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def terms(word: str) -> list[int]:
    """Hash buckets of a lower-cased word and of its stems."""
    names = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]
    return [zlib.crc32(n.encode("utf-8", "replace")) % HASH_BUCKETS for n in names]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class FactorModel:
    """``score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>)`` over the kept terms that a text has."""

    bias: float
    index: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, active: list[np.ndarray]) -> list[float]:
        out = []
        for at in active:
            v = self.factors[at]
            pairs = 0.5 * float(((v.sum(axis=0)) ** 2 - (v**2).sum(axis=0)).sum()) if len(at) else 0.0
            z = self.bias + float(self.weights[at].sum()) + pairs
            out.append(1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30)))))
        return out


def differing(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms whose rates among rows of label 1 and of label 0 differ by MIN_Z standard errors. Counted row by row, so
    that the rows' terms are never in memory twice."""
    counts = np.zeros((2, HASH_BUCKETS), np.int32)
    for row, label in zip(rows, labels.tolist()):
        counts[label, row] += 1
    n0, n1 = np.bincount(labels, minlength=2).tolist()
    there = np.flatnonzero(counts.any(axis=0))
    c0, c1 = counts[:, there].astype(float)
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return there[z >= MIN_Z]


def _pair_slices(lists: list[np.ndarray], labels: np.ndarray):
    """``(first word, second word, label)`` of the pairs of each row's words (sorted numbers), slice by slice."""
    held, size = [], 0
    for words, label in zip(lists, labels.tolist()):
        for k in range(1, len(words)):
            held.append((words[:-k], words[k:], label))
            size += len(words) - k
            if size >= PAIR_SLICE:
                yield tuple(np.concatenate([x[i] for x in held]) for i in (0, 1)) + (np.repeat([x[2] for x in held], [len(x[0]) for x in held]),)
                held, size = [], 0
    if held:
        yield tuple(np.concatenate([x[i] for x in held]) for i in (0, 1)) + (np.repeat([x[2] for x in held], [len(x[0]) for x in held]),)


def interacting(words: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Words that are in a pair whose label rate isn't what its two words' own rates, added up as log odds, say.

    All pairs of words of MIN_PAIR_ROWS rows or more are counted: residuals are summed in hashed buckets, and the
    pairs in buckets that stand out are then counted one by one.
    """
    names, at = np.unique(np.concatenate(words), return_inverse=True)
    owner = np.repeat(labels, [len(x) for x in words])
    count = np.bincount(at, minlength=len(names))
    logit = lambda hit, n: np.log((hit + 0.5) / (n - hit + 0.5))
    base = logit(labels.sum(), len(labels))
    odds = (logit(np.bincount(at, weights=owner, minlength=len(names)) + labels.mean(), count + 1) - base).astype(np.float32)
    frequent = (count >= MIN_PAIR_ROWS)[at]
    ends = np.cumsum([0, *(len(x) for x in words)])
    lists = [at[a:b][frequent[a:b]].astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]

    def spread(a, b):
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)).astype(np.int64) % PAIR_BUCKETS

    def residuals(a, b, y):
        p = 1 / (1 + np.exp(-np.clip(base + odds[a] + odds[b], -4, 4)))
        return y - p, p * (1 - p)

    off, var = np.zeros(PAIR_BUCKETS), np.zeros(PAIR_BUCKETS)
    for a, b, y in _pair_slices(lists, labels):
        place = spread(a, b)
        for total, part in zip((off, var), residuals(a, b, y)):
            np.add.at(total, place, part)
    stands_out = np.abs(off) >= MIN_PAIR_Z * np.sqrt(var)
    stands_out &= var > 0
    if not stands_out.any():
        return np.zeros(0, names.dtype)
    found = []
    for a, b, y in _pair_slices(lists, labels):
        hit = stands_out[spread(a, b)]
        found.append((a[hit], b[hit], y[hit]))
    a, b, y = (np.concatenate([x[i] for x in found]) for i in range(3))
    pairs, place, n = np.unique(a.astype(np.int64) * len(names) + b, return_inverse=True, return_counts=True)
    off, var = (np.bincount(place, weights=x) for x in residuals(a, b, y))
    pairs = pairs[(n >= MIN_PAIR_ROWS) & (np.abs(off) >= MIN_PAIR_Z * np.sqrt(var))]
    return names[np.unique(np.concatenate([pairs // len(names), pairs % len(names)]))]


def fit(rows: list[np.ndarray], words: list[np.ndarray], labels: np.ndarray, share: float | None = None) -> FactorModel:
    """Fit on the distinct term buckets of each text, those of its whole words, and its label (0 or 1). ``share`` is
    the share of label 1 in the population: rows are weighted to it. With one label only, or none, every score is
    that label's: 0 for none."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return FactorModel(30.0 if n1 else -30.0, {}, np.zeros(0), np.zeros((0, FACTORS)))
    kept = np.union1d(differing(rows, labels), interacting(words, labels))
    index = np.full(HASH_BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    mine = [(at := index[row])[at >= 0] for row in rows]
    term, ends = np.concatenate(mine), np.cumsum([0, *(len(x) for x in mine)])
    share = n1 / (n1 + n0) if share is None else share
    weight = np.where(labels == 1, share * len(labels) / n1, (1 - share) * len(labels) / n0)
    rng = np.random.default_rng(11)
    table = np.concatenate([np.zeros((len(kept), 1)), rng.normal(0, INITIAL_FACTOR, (len(kept), FACTORS))], axis=1)
    bias = np.array([math.log(share / (1 - share))])
    mean, spread = [np.zeros(1), np.zeros_like(table)], [np.zeros(1), np.zeros_like(table)]
    for step in range(1, STEPS + 1):
        part = rng.integers(0, len(labels), BATCH)
        size = ends[part + 1] - ends[part]
        own = np.repeat(np.arange(BATCH), size)
        active = term[np.repeat(ends[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        if step <= STEPS - WHOLE_STEPS:
            keep = rng.random(len(own)) < (TERM_KEEP + (1 - TERM_KEEP) * rng.random(BATCH))[own]
            own, active = own[keep], active[keep]
        at_term = table[active]
        total = _sums(at_term, own, BATCH)
        square = _sums((at_term[:, 1:] ** 2).sum(axis=1, keepdims=True), own, BATCH)[:, 0]
        z = bias[0] + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - square)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / BATCH
        each = np.concatenate([g[own, None], g[own, None] * (total[own, 1:] - at_term[:, 1:])], axis=1)
        for value, m, s, grad in ((bias, mean[0], spread[0], np.array([g.sum()])), (table, mean[1], spread[1],
            _sums(each, active, len(kept)) + L2 * table)):
            m[...] = 0.9 * m + 0.1 * grad
            s[...] = 0.999 * s + 0.001 * grad**2
            value -= LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorModel(float(bias[0]), {int(k): i for i, k in enumerate(kept)}, table[:, 0], table[:, 1:])


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group 0..n-1."""
    return np.stack([np.bincount(group, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def fit_on_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorModel:
    """Fit on whole texts of a bounded sample of labelled rows outside the held-out fold, weighted to the share of
    label 1 among all of them. Rows without a label of 0 or 1 are left out; a document labelled both ways counts as
    1; of the texts of a repeated id one counts; null texts have no terms.

    One task fits, on the hashed terms of SAMPLE_TOXIC + SAMPLE_CLEAN documents at most; only the model, its kept
    terms' weights, comes to the driver.
    """
    bound_arrow_batches(docs.sparkSession)
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    lab = lab.where(fold(F.col("id")) != HELD_OUT_FOLD).groupBy("id").agg(F.max("y").alias("y"))
    known, toxic = lab.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = toxic / known if known else None
    order = F.xxhash64("id")
    chosen = lab.where("y = 1").orderBy(order, "id").limit(SAMPLE_TOXIC).unionByName(lab.where("y = 0").orderBy(order, "id").limit(SAMPLE_CLEAN))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def hashed(batches):
        for batch in batches:
            whole, out = [], []
            for text in batch.column(2):
                each = [terms(w) for w in words_of(text.as_py())]
                whole.append(np.unique([t[0] for t in each]).astype("<i4").tobytes())
                out.append(np.unique([t for found in each for t in found]).astype("<i4").tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(whole, pa.binary())], ["id", "y",
                "terms", "words"])

    def fitted(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary()),
            ("words", pa.binary())]))
        got = got.sort_by([("id", "ascending"), ("terms", "ascending")])
        rows, words = ([np.frombuffer(b.as_py(), "<i4") for b in got.column(c)] for c in ("terms", "words"))
        model = fit(rows, words, np.array(got.column("y").to_pylist(), np.int64), share)
        names = np.array(list(model.index), np.int64)
        yield pa.record_batch([pa.array([model.bias]), *(pa.array([x.astype("<f8" if x.dtype.kind == "f" else "<i8").tobytes()],
            pa.binary()) for x in (names, model.weights, model.factors))], ["bias", "names", "weights", "factors"])

    sample = picked.select("id", "y", "text").mapInArrow(hashed, "id long, y int, terms binary, words binary")
    sample = sample.groupBy("id", "y").agg(F.max(F.struct("terms", "words")).alias("of")).select("id", "y", "of.terms", "of.words").coalesce(1)
    got = sample.mapInArrow(fitted, "bias double, names binary, weights binary, factors binary").first()
    if got is None:
        return fit([], [], np.zeros(0, np.int64))
    names = np.frombuffer(got.names, "<i8").tolist()
    return FactorModel(got.bias, {k: i for i, k in enumerate(names)}, np.frombuffer(got.weights, "<f8"), np.frombuffer(got.factors,
        "<f8").reshape(-1, FACTORS))


class _Scorer:
    """Scores of a batch of texts; remembers which kept terms a word has."""

    def __init__(self, model: FactorModel):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: pa.Array) -> list[float]:
        active = []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text.as_py()):
                hit = self.known.get(word)
                if hit is None:
                    hit = tuple(i for t in terms(word) if (i := self.model.index.get(t)) is not None)
                    if len(self.known) >= CACHED_WORDS:
                        self.known.clear()
                    self.known[word] = hit
                found.update(hit)
            active.append(np.array(sorted(found), np.int64))
        return self.model.scores(active)


def score_texts(docs: DataFrame, model: FactorModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row, repeated ones and null ids too; null and empty texts score by the bias alone."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        scorer = _Scorer(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scorer(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    The model sees texts only. Null and empty texts score by the bias alone; a null id is in no fold and not held
    out; repeated rows score alike; an empty table gives no rows; other columns are ignored. A text of any length is
    scored whole, by the task that reads it.
    """
    scored = score_texts(docs, fit_on_sample(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns. Null and empty texts score by the bias
    alone; repeated rows stay or go alike; null ids are judged like others; an empty table gives no rows."""
    model = fit_on_sample(docs, labels)
    bound_arrow_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        scorer = _Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score < THRESHOLD for score in scorer(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, schema)
