"""Importance resampling towards a target distribution.

Hashed word counts of all documents and of the target texts give each bucket a gain; a document's weight is the sum of
its features' gains, and a seeded Gumbel term makes the highest scores a draw without replacement. Scores are cut into
ranges at a sample's quantiles and counted exactly, so each range knows its first rank. Partitions are sorted into runs;
the runs of a range meet in one task, which merges them with a tournament tree, a block of each run in memory, and stops
at the draw's end.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
DRAW_PERCENT = 10
SEED = 2024
#: Features whose gain a worker remembers; it forgets all when full.
REMEMBERED = 1 << 18
#: Rows of a range aimed at, ranges at least and at most, and sampled rows for each range.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLE_EACH = 200_000, 240, 4096, 64
#: Entries of a block of a run.
RUN_BLOCK = 4096
#: Stands for a null id among equal scores: last.
NO_ID = (1 << 63) - 1
SCORED = ["doc_id", "n_words", "n_features", "weight", "score", "tie"]
RUN = ("range int, first_down long, first_tie long, first_n_features long, first_weight long, down array<long>, tie array<long>, "
    "n_features array<long>, weight array<long>, n array<long>")

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

#: Bytes of words: digits, letters, and all beyond ASCII; A-Z become a-z, and all others end a word.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))


def features_in(text: bytes | None, most: int = MOST_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """``(words, features)`` of a text, piece by piece: features are runs of 1 to ``most`` words, joined by a space, each
    in the piece of its last word."""
    body, begin, tail = (text or b"").translate(WORD_BYTES), 0, []
    while begin < len(body):
        end = body.find(b" ", begin + PIECE)
        end = len(body) if end < 0 else end
        words = body[begin:end].split()
        known, both = len(tail), tail + words
        runs = [b" ".join(both[i : i + k]) for k in range(2, most + 1) for i in range(max(0, known - k + 1), len(both) - k + 1)]
        yield len(words), words + runs
        begin, tail = end, both[-(most - 1) :] if most > 1 else []


def gains_of(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Each bucket's gain from its counts among the documents and in the target."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(),
        target.tolist())]


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """A feature's gain."""

    def __init__(self, gains: list[int]):
        super().__init__()
        self.gains = gains

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        gain = self[feature] = self.gains[zlib.crc32(feature) % len(self.gains)]
        return gain


def bucket_counts(texts: DataFrame, text_col: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total, seen = np.zeros(buckets, np.int64), Counter()

        def add() -> None:
            at = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                for _, features in features_in(text.as_py(), most):
                    seen.update(features)
                if len(seen) > REMEMBERED:
                    add()
        add()
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def scored(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS,
    seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, tie`` of every document."""

    def score(batches):
        gain = _Gains(gains)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = n_features = weight = 0
                for n, features in features_in(text.as_py(), most):
                    n_words, n_features, weight = n_words + n, n_features + len(features), weight + sum(map(gain.__getitem__, features))
                out.append((doc_id, n_words, n_features, weight, weight + gumbel(doc_id, seed), NO_ID if doc_id is None else doc_id))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], SCORED)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(score, ", ".join(f"{c} long" for c in SCORED))


class Tournament:
    """Merges sorted runs, the least head first: a tree whose inner nodes name the winner of the two below, so a step
    replays one path from leaf to root. Runs may enter at any time, at a free leaf."""

    def __init__(self):
        self.heads, self.runs, self.won, self.free = [None], [iter(())], [0, 0], [0]

    def _replay(self, leaf: int) -> None:
        node = (leaf + len(self.heads)) // 2
        while node:
            self.won[node] = self._winner(self.won[2 * node], self.won[2 * node + 1])
            node //= 2

    def _winner(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def _grow(self) -> None:
        n = len(self.heads)
        self.heads, self.runs, self.free = self.heads + [None] * n, self.runs + [iter(())] * n, list(range(n, 2 * n))
        self.won = [0] * (2 * n) + list(range(2 * n))
        for node in range(2 * n - 1, 0, -1):
            self.won[node] = self._winner(self.won[2 * node], self.won[2 * node + 1])

    def enter(self, run: Iterator) -> None:
        if not self.free:
            self._grow()
        leaf = self.free.pop()
        self.runs[leaf], self.heads[leaf] = run, next(run, None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)

    def head(self):
        """The least head; None if all runs have ended."""
        return self.heads[self.won[1]]

    def pop(self):
        leaf = self.won[1]
        out, self.heads[leaf] = self.heads[leaf], next(self.runs[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)
        return out


def merged(blocks: Iterator[list[tuple]], stop: Callable[[], bool] = lambda: False) -> Iterator[tuple]:
    """Entries of sorted runs in order. The runs' blocks come by their first entries, so a block is opened no earlier
    than one of its entries may be next. Once ``stop()`` holds, what is left comes as it lies."""
    tree = Tournament()
    for block in blocks:
        while not stop() and (head := tree.head()) is not None and head <= block[0]:
            yield tree.pop()
        if stop():
            yield from block
        else:
            tree.enter(iter(block))
    while tree.head() is not None:
        yield tree.pop()


def _runs(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Each partition's rows as a sorted run: a row for each block, equal rows as one entry with their number."""

    def pack(batches):
        block, at = [], None

        def packed():
            return pa.record_batch([pa.array([at], pa.int32()), *(pa.array([x], pa.int64()) for x in block[0][:4]),
                *(pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*block))], [x.split()[0] for x in RUN.split(", ")])

        for batch in batches:
            for down, tie, n_features, weight in zip(*(batch.column(c).to_pylist() for c in ("down", "tie", "n_features", "weight"))):
                key, where = (down, tie, n_features, weight), bisect_right(cuts, (down, tie))
                if block and block[-1][:4] == key:
                    block[-1] = (*key, block[-1][4] + 1)
                    continue
                if block and (where != at or len(block) == RUN_BLOCK):
                    yield packed()
                    block = []
                at = where
                block.append((*key, 1))
        if block:
            yield packed()

    ordered = rows.select((-F.col("score")).alias("down"), "tie", "n_features", "weight").sortWithinPartitions("down", "tie", "n_features",
        "weight")
    return ordered.mapInArrow(pack, RUN)


def ranked(rows: DataFrame, draw: int, cuts: list[tuple[int, int]], counts: list[int]) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of ``rows``, all of the ranges that hold the first ``draw``.
    ``cuts``: the first ``(-score, tie)`` of each range but the first; ``counts``: rows of each."""
    before = [0, *accumulate(counts)]

    def ranks(batches):
        blocks = (r for batch in batches for r in batch.to_pylist())
        for at, some in groupby(blocks, key=lambda r: r["range"]):
            done, out = before[at], []
            read = (list(zip(r["down"], r["tie"], r["n_features"], r["weight"], r["n"])) for r in some)
            for down, tie, n_features, weight, n in merged(read, lambda: done >= draw):
                while n:
                    # Repeated rows leave in parts, those within the draw apart from the others.
                    part = min(n, RUN_BLOCK, draw - done if done < draw else n)
                    out.append((tie, n_features, weight, -down, done + 1 if done < draw else None, part))
                    done, n = done + part, n - part
                if len(out) >= RUN_BLOCK:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    n = len(counts)
    runs = _runs(rows, cuts).repartition(n, "range").sortWithinPartitions("range", "first_down", "first_tie", "first_n_features", "first_weight")
    entries = runs.mapInArrow(ranks, "tie long, n_features long, weight long, score long, first long, n long")
    rank = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    return entries.repartition(n, "first", "tie", "n").select("*", rank).select(F.when(F.col("tie") != NO_ID, F.col("tie")).alias("doc_id"), "n_features",
        "weight", "score", (F.col("first") + F.col("k")).alias("rank"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], ["tie", "n_features", "weight", "score", "first", "n"])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    most: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: the highest ``percent`` scores among those with
    ``least_words`` words or more have ranks 1, 2, ..., ties to smaller ids; all others have a null rank.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a feature is a run of 1 to ``most``
    of them. Null texts, and texts without a word, have no features, weight 0 and are not drawn where ``least_words``
    is 1 or more. A null id draws by the empty id and loses ties. Repeated rows are rows of their own, with ranks one
    after the other. Texts of any length are read piece by piece. An empty table gives no rows; without target texts
    all counts of the target are 0. Other columns of either table are not read. The largest id of 64 bits stands for
    null inside.
    """
    bound_arrow_batches(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets))
    rows = written(scored(docs, gains, id_col, text_col, most, seed), "resampling-scores")
    fit = F.col("n_words") >= least_words
    n = rows.where(fit).count()
    draw = percent * n // 100
    undrawn = ("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not draw:
        return rows.select(*undrawn)
    n_ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-n // RANGE_ROWS)))
    some = rows.where(fit).sample(fraction=min(1.0, SAMPLE_EACH * n_ranges / n), seed=seed).limit(4 * SAMPLE_EACH * n_ranges)
    keys = sorted((-r.score, r.tie) for r in some.select("score", "tie").collect())
    cuts = sorted({keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)}) if keys else []

    def count(batches):
        seen = Counter()
        for batch in batches:
            seen.update(bisect_right(cuts, (-s, t)) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["range", "n"])

    counts = [0] * (len(cuts) + 1)
    for r in rows.where(fit).select("score", "tie").mapInArrow(count, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        counts[r["range"]] = r["n"]
    last = bisect_left(list(accumulate(counts)), draw)
    inside = fit
    if last < len(cuts):
        down, tie = cuts[last]
        inside = fit & ((F.col("score") > -down) | ((F.col("score") == -down) & (F.col("tie") < tie)))
    drawn = ranked(rows.where(inside), draw, cuts[: last], counts[: last + 1])
    return drawn.unionByName(rows.where(~inside).select(*undrawn))
