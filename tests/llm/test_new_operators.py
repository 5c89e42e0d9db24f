"""Hard negatives, the inverted multi-index and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, resampling
from tidemark.llm.ann import MultiIndex, nearest_neighbours, walk
from tidemark.llm.hard_negatives import VectorFile, approximate, borders, hard_negatives
from tidemark.llm.queries import QUERIES
from tidemark.llm.resampling import Tournament, features_in, gains_of, merged, resample

ODD_VECTORS = [(300, None, 0), (301, [1.0, None, 0.0], 0), (302, [float("nan")] * 3, 1), (303, [float("inf"), 0.0, 0.0], 1),
    (None, [0.1, 0.2, 0.3], 0), (304, [0.5, 0.5], 1), (305, [0.0, 0.0, 0.0], 0), (306, [], 1)]


def vectors(spark, rows):
    """``vec_id, embedding, label`` and columns whose names clash with those inside."""
    full = [(i, v, label, 1, 2, "x", 3) for i, v, label in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, rid int, c int, v string, block int")


def floored(v, width):
    return [math.floor(256 * x) for x in v] + [0] * (width - len(v))


def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90):
    fine = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in fine)
    fine = [(i, np.array(floored(v, width)), label) for i, v, label in fine]
    out = set()
    for a, q, label in fine:
        if a % every:
            continue
        score = [(-int(q @ v), i, other) for i, v, other in fine if i != a]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            near = sorted((t, i) for t, i, other in score if other != label and low * -s <= 100 * -t <= high * -s)
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(near[:negatives])}
    return out


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.5) for _ in range(3)], rng.randrange(3)) for i in range(280)]
    rows += [(400 + i, [0.4, 0.3, 0.2], i % 4) for i in range(60)] + ODD_VECTORS + [(307, [0.1, 0.1, 0.1], None)]
    df = vectors(spark, rows)
    for size in ({}, {"file_block": 40, "anchor_block": 2}):
        got = hard_negatives(df, anchor_every=20, **size)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert {tuple(r) for r in got.collect()} == brute_negatives(rows, 20)
    assert hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives(vectors(spark, [(0, [1.0], 1), (1, [1.0], 1)])).count() == 0


def test_hard_negatives_of_repeated_ids(spark):
    """Rows without an id take no part; rows that repeat one id, half of all, ask once and are rows of their own."""
    rows = [(i, [0.1 * (i % 7), 0.2], i % 2) for i in range(40)] + [(100, [0.3, 0.4], 0)] * 40 + [(None, [0.5, 0.5], 1)] * 40
    got = hard_negatives(vectors(spark, rows)).collect()
    assert {r.anchor_id for r in got} == {0, 100}
    assert Counter((r.positive_id, r["rank"]) for r in got if r.anchor_id == 0)[(100, 1)] == 5


def test_bounds_hold_and_skip_rows():
    rng = np.random.default_rng(2)
    for scale in (3, 200, 10**6, 2**27):
        m = rng.integers(-scale, scale + 1, (700, 6))
        labels = np.sort(rng.integers(0, 4, 700))
        block = VectorFile(np.arange(700), labels, *approximate(m, borders(m[:200].astype(float))), m)
        q = rng.integers(-scale, scale + 1, (5, 6))
        exact = m.astype(object) @ q.T.astype(object)
        least, most = block.bounds(q, slice(0, 700))
        assert (least <= exact).all() and (exact <= most).all()
        rows, score, seen = block.best(q[0], labels != 1, least[:, 0], most[:, 0], 4, 0)
        want = sorted((-int(s), i) for i, s in enumerate(exact[:, 0]) if labels[i] != 1 and s >= 0)[:4]
        assert [(-int(s), int(i)) for i, s in zip(rows, score)] == want and seen < 200


def test_walk_meets_cells_in_order():
    rng = np.random.default_rng(4)
    first, second = rng.random(7), rng.random(5)
    held = rng.integers(0, 3, 35)
    every = walk(first, second, held, 10**9)
    total = (first[:, None] + second[None]).ravel()
    assert sorted(every) == np.flatnonzero(held).tolist() and (np.diff(total[every]) >= 0).all()
    some = walk(first, second, held, 6)
    assert some == every[: len(some)] and held[some].sum() >= 6 > held[some[:-1]].sum()


def cosine(a, b):
    w = max(len(a), len(b))
    a, b = (np.array([c / max(map(abs, x)) for c in x] + [0.0] * (w - len(x))) for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def test_small_tables_are_searched_whole(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(45)] + [(60, [1e200, 2e200, 0.0], 0), (61, [1e-200, 2e-200, 0.0], 0),
        (62, [1.0, 2.0], 0), (63, [2.0, 4.0, 0.0], 0)]
    df = vectors(spark, rows + ODD_VECTORS)
    fine = dict((i, v) for i, v, _ in rows) | {304: [0.5, 0.5]}
    got = defaultdict(list)
    for r in nearest_neighbours(df, query_every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 10, 20, 30, 40, 60}
    for q, found in got.items():
        want = sorted((-round(cosine(fine[q], v), 12), i) for i, v in fine.items() if i != q)[:5]
        assert sorted((-round(s, 12), i) for i, s in found) == want
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert nearest_neighbours(df.limit(0)).count() == 0
    assert nearest_neighbours(vectors(spark, [(50, [1.0], 0)])).count() == 0
    two = nearest_neighbours(vectors(spark, [(50, [1.0], 0), (50, [2.0], 0), (51, [-2.0], 0)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in two] == [(50, 1, 51, -1.0)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    m = np.array([r.embedding for r in rows])
    length, ids = m / np.sqrt((m * m).sum(axis=1))[:, None], np.array([r.vec_id for r in rows])
    met = total = 0
    found = defaultdict(list)
    for r in QUERIES["op12_ann"](spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    for k in np.flatnonzero(ids % 50 == 0):
        near = length @ length[k]
        near[k] = -9
        got = found[int(ids[k])]
        assert len(got) == 5 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        assert all(abs(near[np.flatnonzero(ids == i)[0]] - s) < 1e-12 for i, s in got)
        met += len(set(ids[np.argsort(-near)[:5]].tolist()) & {i for i, _ in got})
        total += 5
    assert met >= 0.9 * total, (met, total)


def test_clusters_need_a_small_share(spark):
    """Where vectors lie in clusters a walk meets few rows; one cell may hold a third of them, over several blocks."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16))
    m = np.concatenate([centres[rng.integers(0, 300, 4000)] + 0.05 * rng.normal(size=(4000, 16)), np.repeat(centres[:1], 2000, axis=0)])
    assert MultiIndex(ann.matrix(list(m[:3000]), 16)).share < 0.15
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    length, got = ann.unit(m), defaultdict(list)
    for r in nearest_neighbours(df, entry_block=500, query_every=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    met = 0
    for q in range(0, 6000, 100):
        near = np.round(length @ length[q], 9)
        near[q] = -9
        met += len(set(np.lexsort((np.arange(6000), -near))[:5].tolist()) & set(got[q]))
    assert met >= 0.9 * 300, met


def test_tournament_merges_runs():
    rng = random.Random(7)
    runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(40))) for _ in range(23)]
    tree = Tournament()
    for r in runs:
        tree.enter(iter(r))
    assert [tree.pop() for _ in range(sum(map(len, runs)))] == sorted(x for r in runs for x in r) and tree.head() is None
    blocks = sorted((r[i : i + 3] for r in runs for i in range(0, len(r), 3)), key=lambda b: b[0])
    assert list(merged(iter(blocks))) == sorted(x for r in runs for x in r)
    taken = []
    for x in merged(iter(blocks), lambda: len(taken) >= 60):
        taken.append(x)
    every = sorted(x for r in runs for x in r)
    assert taken[:60] == every[:60] and sorted(taken) == every


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, targets, most=1, least=20, percent=10, seed=2024, buckets=10_000):
    def features(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(text for _, text in docs), counts(targets)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, fs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((n, doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    cut = percent * len(fit) // 100
    out = Counter((*r[1:], k + 1 if k < cut else None) for k, r in enumerate(fit))
    return out + Counter((*r[1:], None) for r in rows if r[0] < least)


def test_resampling_equals_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "ЧАС", "3D", "naïve"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " ,;\n"), (None, "one two " * 15), (None, "one two " * 15), (403, "Z" * 5000 + " a" * 30)]
    rows += [(500, "again and again " * 9)] * 120 + [(None, "w1 w2 w3 " * 9)] * 90
    targets = ["w1 w2 w3", None, "", "one Äpfel w2 w2"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(targets)], "item_id long, text string, score int")
    docs = make_docs(rows).repartition(5)
    for limits in ({}, {"LEAST_RANGES": 3, "RUN_BLOCK": 7, "PIECE": 20, "REMEMBERED": 5}):
        for k, v in limits.items():
            monkeypatch.setattr(resampling, k, v)
        for most, percent, least in ((1, 10, 20), (3, 60, 1), (1, 100, 0)):
            got = resample(docs, bench, most=most, percent=percent, least_words=least)
            assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
            assert Counter(map(tuple, got.collect())) == brute_resample(rows, targets, most, least, percent)
    assert resample(docs.limit(0), bench).count() == 0
    assert Counter(map(tuple, resample(make_docs(rows[:50]), bench.limit(0)).collect())) == brute_resample(rows[:50], [])


def test_features_by_pieces(monkeypatch):
    text = "One two-THREE four five Été 6".encode()
    whole = Counter(f for _, fs in features_in(text, 3) for f in fs)
    monkeypatch.setattr(resampling, "PIECE", 4)
    assert Counter(f for _, fs in features_in(text, 3) for f in fs) == whole
    assert sum(n for n, _ in features_in(text, 3)) == 7 and whole[b"three four five"] == 1
    assert gains_of(np.array([0, 9]), np.array([3, 0])) == [math.floor(1000 * math.log(4 * 11 / (1 * 5))), math.floor(1000 * math.log(11 / 50))]


def test_draw_is_the_same_however_rows_lie(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = {tuple(r) for r in resample(docs, bench).collect()}
    assert first == {tuple(r) for r in resample(docs.repartition(7, F.hash("text")), bench).collect()}
