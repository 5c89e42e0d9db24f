"""Substring deduplication by difference-cover anchors.

Runs of ANCHOR words are hashed only at positions whose residue modulo PERIOD is in a difference cover. For any two
positions some shift below PERIOD brings both onto cover residues, so two equal windows of WINDOW = ANCHOR + PERIOD - 1
words always hold an equal anchor at equal shifts. Anchors met in two different texts extend to every window around
them, and full windows are then compared across documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

WINDOW = 50
#: A perfect difference set: each non-zero residue modulo 31 is the difference of exactly one pair.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task gathers before it groups and packs them.
FLUSH = 1 << 20
#: Anchors that one reducing group holds at most, about; the number of buckets follows the input from this.
BUCKET_ANCHORS = 1 << 16
CACHED_WORDS = 1 << 18

_BASE = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], filled = 1, 1
            while filled < size:
                with np.errstate(over="ignore"):
                    p[filled : 2 * filled] = p[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
            out.append(p)
        have = _powers[which] = (out[0], out[1])
    return have


def run_hashes(hashes: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the run of ``length`` words from each position, by prefix sums of a polynomial modulo 2^64."""
    up, down = _power(which, len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
        return mixed((sums[at + length] - sums[at]) * down[at])


def anchor_positions(n: int) -> np.ndarray:
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def anchor_keys(hashes: np.ndarray, at: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Bucket and 32 bits more of each anchor's hash. A chance equality only adds windows to compare."""
    return run_hashes(hashes, at, ANCHOR) >> np.uint64(32 - bucket_bits)


def window_keys(hashes: np.ndarray, at: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, key)`` of each window, from two independent hashes: 64 + bucket_bits bits decide equality."""
    second = mixed(hashes ^ np.uint64(0xA0761D6478BD642F))
    return run_hashes(second, at, WINDOW, 1) >> np.uint64(64 - bucket_bits), run_hashes(hashes, at, WINDOW)


def _grouped(owner: np.ndarray, values: np.ndarray):
    """``(owner, values)`` of each run of equal owners, after a sort by owner."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], len(owner)]):
        yield owner[a], values[a:b]


def _text_id(sha: str) -> int:
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


_A = "kind string, bucket int, id long, n long, sha string, a binary, b binary"
_A_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("a",
    pa.binary()), ("b", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([],
        t) for t in schema.types], schema=schema)


def _find_anchors(bucket_bits: int):
    """Of each document its word count and digest (kind N); of each task's anchors one text (kind R), and those met
    in several texts of the task with their texts (kind S)."""

    def flush(keys: list[np.ndarray], ids: list[int]):
        key = np.concatenate(keys)
        owner = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        first = np.r_[True, key[1:] != key[:-1]]
        several = np.diff(np.r_[np.flatnonzero(first), len(key)]) > 1
        shared = several[np.cumsum(first) - 1]
        for tid, ks in _grouped(owner[shared], key[shared]):
            yield ("S", None, int(tid), None, None, ks.astype("<u8").tobytes(), None)
        key, owner = key[first], owner[first]
        bucket = (key >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(key)]):
            yield ("R", int(bucket[a]), None, None, None, key[a:b].astype("<u4").tobytes(), owner[a:b].astype("<i8").tobytes())

    def run(batches):
        keys, ids, seen, held = [], [], set(), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                out.append(("N", None, doc_id, len(words), sha, None, None))
                tid = _text_id(sha)
                if doc_id is None or len(words) < WINDOW or tid in seen:
                    continue
                seen.add(tid)
                hashes = word_hashes(words)
                keys.append(np.unique(anchor_keys(hashes, anchor_positions(len(words)), bucket_bits)))
                ids.append(tid)
                held += len(keys[-1])
                if held >= FLUSH:
                    out.extend(flush(keys, ids))
                    keys, ids, seen, held = [], [], set(), 0
            yield _rows(out, _A_SCHEMA)
        if keys:
            yield _rows(list(flush(keys, ids)), _A_SCHEMA)

    return run


def _meet_anchors(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors of one bucket that tasks report for several texts."""
    bucket = int(key[0]) << 32
    k = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["a"]]).astype(np.uint64)
    t = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["b"]])
    order = np.lexsort((t, k))
    k, t = k[order], t[order]
    again = np.r_[False, (k[1:] == k[:-1]) & (t[1:] == t[:-1])]
    k, t = k[~again], t[~again]
    first = np.r_[True, k[1:] != k[:-1]]
    shared = (np.diff(np.r_[np.flatnonzero(first), len(k)]) > 1)[np.cumsum(first) - 1]
    out = [(int(tid), (ks + np.uint64(bucket)).astype("<u8").tobytes()) for tid, ks in _grouped(t[shared], k[shared])]
    return pd.DataFrame(out, columns=["id", "a"])


_B = "kind string, bucket int, doc_id long, sha string, text binary, a binary, b binary"
_B_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.string()), ("text", pa.binary()),
    ("a", pa.binary()), ("b", pa.binary())])


def candidate_windows(hashes: np.ndarray, shared: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Positions of the windows that hold an anchor in ``shared``."""
    at = anchor_positions(len(hashes))
    hit = at[np.isin(anchor_keys(hashes, at, bucket_bits), shared)]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(edge, hit + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, len(hashes) - WINDOW + 1)] > 0)


def _find_windows(anchor_bits: int, bucket_bits: int):
    """Candidate windows of each text: in a task, the smallest document of each (kind W) and the windows that larger
    ones lose to it (kind X); and the text itself (kind T)."""

    def flush(parts):
        bucket, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
        order = np.lexsort((doc, key, bucket))
        bucket, key, doc = bucket[order], key[order], doc[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
        smallest = doc[first][np.cumsum(first) - 1]
        lost = doc > smallest
        for d, ks in _grouped(doc[lost], key[lost]):
            yield ("X", None, int(d), None, None, np.unique(ks).astype("<u8").tobytes(), None)
        bucket, key, doc = bucket[first], key[first], doc[first]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(key)]):
            yield ("W", int(bucket[a]), None, None, None, key[a:b].astype("<u8").tobytes(), doc[a:b].astype("<i8").tobytes())

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            out = []
            for doc_id, text, sha, lists in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or b"").split()
                if hashlib.sha256(b" ".join(words)).hexdigest() != sha:
                    continue  # another text under a repeated id
                hashes = word_hashes(words)
                at = candidate_windows(hashes, np.concatenate([np.frombuffer(x, "<u8") for x in lists]), anchor_bits)
                if not len(at):
                    continue
                out.append(("T", None, doc_id, sha, text, None, None))
                parts.append((*window_keys(hashes, at, bucket_bits), doc_id))
                held += len(at)
                if held >= FLUSH:
                    out.extend(flush(parts))
                    parts, held = [], 0
            yield _rows(out, _B_SCHEMA)
        if parts:
            yield _rows(list(flush(parts)), _B_SCHEMA)

    return run


def _meet_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of one bucket that a document loses to a smaller one of another task."""
    k = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["a"]])
    d = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["b"]])
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    first = np.r_[True, k[1:] != k[:-1]]
    lost = d > d[first][np.cumsum(first) - 1]
    out = [(int(doc), np.unique(ks).astype("<u8").tobytes()) for doc, ks in _grouped(d[lost], k[lost])]
    return pd.DataFrame(out, columns=["doc_id", "a"])


def kept_mask(hashes: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """True for each word that no window in ``lost`` covers."""
    at = np.arange(max(0, len(hashes) - WINDOW + 1))
    hit = at[np.isin(run_hashes(hashes, at, WINDOW), lost)]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.cumsum(edge)[: len(hashes)] == 0


def _cut(batches):
    schema = pa.schema([("c_id", pa.int64()), ("c_sha", pa.string()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])
    for batch in batches:
        out = []
        for doc_id, sha, text, lists in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = text.split()
            keep = kept_mask(word_hashes(words), np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in lists])))
            out.append((doc_id, sha, int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])))
        yield _rows(out, schema)


def bucket_bits_for(total_bytes: int) -> int:
    """Bits of the bucket number, so that a bucket of anchors stays near BUCKET_ANCHORS at any input size."""
    anchors = total_bytes / 6 * len(COVER) / PERIOD
    return min(30, max(6, math.ceil(math.log2(max(1.0, anchors / BUCKET_ANCHORS)))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, whole_sha256, kept_text``.

    A word goes if a window of WINDOW words over it also starts in a document with a smaller id. ``kept_text`` is
    the kept words joined by a space where some are kept and some removed, else null; ``whole_sha256`` is the digest
    of all words, joined likewise. Null text has no words; rows with a null id neither lose words nor take any;
    repeated rows of one id never count as smaller than each other; an empty table gives no rows; other columns are
    ignored. A text of any length is read whole, by the task that reads it.

    Texts equal word for word are taken together first: the one with the smallest id stands for them, the others
    lose every word if they have a window at all. Tasks pre-aggregate each hash to one row before the shuffle, so
    a passage in a third of all documents gives one row a task.
    """
    bound_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = bucket_bits_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    found = written(docs.mapInArrow(_find_anchors(bits), _A), "cover-anchors", partition_by="kind")
    whole = found.where("kind = 'N'").select(F.col("id").alias("doc_id"), "n", "sha")
    smallest = written(whole.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first_id")), "cover-texts")
    met = found.where("kind = 'R'").select("bucket", "a", "b").groupBy("bucket").applyInPandas(_meet_anchors, "id long, a binary")
    shared = found.where("kind = 'S'").select("id", "a").unionByName(met).groupBy("id").agg(F.collect_list("a").alias("keys"))
    tid = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    wanted = smallest.withColumn("id", tid).join(shared, "id").select(F.col("first_id").alias("doc_id"), "sha", "keys")

    pairs = docs.join(wanted, "doc_id").select("doc_id", "text", "sha", "keys")
    windows = written(pairs.mapInArrow(_find_windows(bits, bits), _B), "cover-windows", partition_by="kind")
    lost = windows.where("kind = 'W'").select("bucket", "a", "b").groupBy("bucket").applyInPandas(_meet_windows, "doc_id long, a binary")
    lost = windows.where("kind = 'X'").select("doc_id", "a").unionByName(lost).groupBy("doc_id").agg(F.collect_list("a").alias("keys"))
    texts = windows.where("kind = 'T'").select("doc_id", "sha", "text").dropDuplicates(["doc_id", "sha"])
    cut = texts.join(lost, "doc_id").select("doc_id", "sha", "text", "keys").mapInArrow(_cut,
        "c_id long, c_sha string, n_removed long, kept_text binary")

    marked = whole.join(smallest, "sha", "left").withColumn("copy", (F.col("doc_id") > F.col("first_id")) & (F.col("n") >= WINDOW))
    out = marked.join(cut, (F.col("sha") == F.col("c_sha")) & (F.col("doc_id") == F.col("c_id")), "left")  # by id too: copies share a digest
    copy = F.coalesce("copy", F.lit(False))
    removed = F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), F.col("sha").alias("whole_sha256"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"))


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`remove_repeats`."""
    kept = F.when(F.col("n_removed") == 0, F.col("whole_sha256")).otherwise(F.sha2(F.coalesce("kept_text", F.lit("").cast("binary")), 256))
    return remove_repeats(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))
