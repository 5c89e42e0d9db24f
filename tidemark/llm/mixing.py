"""Mixing sources to target weights: fixed-length token blocks, a multinomial draw of source counts for each output
shard, per-source pseudorandom block permutations, and a join of blocks by index.

All output shards have the same number of slots, save the last. Shard by shard, a multinomial draw gives the slots of
each source, with probabilities by what is left of the sources' targets: a shard's draw makes up for the ones before,
so a source's total misses its target by no more than about three standard deviations of one shard's draw."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, fresh_names, release, written

BLOCK_WORDS = 64
OUTPUT_SHARDS = 64
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20240607
DRAW_SEED = 8
#: The plan has a row for each source and shard on the driver: more sources than this are refused.
MAX_SOURCES = 10_000
#: Slots that are placed in one go.
PIECE = 1 << 16
#: Buckets of a source within which running offsets are summed.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words to take of each source. Sources by code point, null last, weigh ``weights`` in turn and share the sum
    of all sizes; a target stops at ``most`` times its source's size and what is over is shared again by weight."""
    order = sorted((s for s, _ in sizes if s is not None)) + ([None] if any(s is None for s, _ in sizes) else [])
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    free, rest = set(order), float(sum(size.values()))
    while free and rest > 0:
        total = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and rest * weight[s] / total >= most * size[s]]
        if not over:
            for s in order:
                if s in free:
                    target[s] = rest * weight[s] / total
            break
        for s in over:
            target[s] = float(most * size[s])
            rest -= target[s]
            free.discard(s)
    return target


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each ``index`` in 0..size-1 under the pseudorandom permutation of 0..size-1 that ``key`` names: a four-round
    Feistel network over the next power of four, walked until the value is in range."""
    half = np.ceil(np.ceil(np.log2(np.maximum(size, 2))) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    bound = size.astype(np.uint64)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for step in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (_mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= bound[todo]
    return out.astype(np.int64)


def draw_slots(blocks: list[int], wanted: list[int], shards: int = OUTPUT_SHARDS, seed: int = DRAW_SEED,
    most: float = MAX_REPEATS) -> list[tuple[int, int, int, int]]:
    """``(shard, source, first slot, slots)``, by shard and source, of sources 0, 1, ... with so many ``blocks`` and
    ``wanted`` slots. No source gets more than ``most`` times its blocks: what a draw gives beyond is drawn again
    among the others."""
    rng = np.random.Generator(np.random.PCG64(seed))
    want, used, most_slots = np.array(wanted, np.int64), np.zeros(len(wanted), np.int64), (np.array(blocks, np.int64) * most).astype(np.int64)
    total, rows = int(want.sum()), []
    each = -(-total // shards)
    for shard in range(shards):
        todo, drawn = min(each, total - shard * each), np.zeros_like(used)
        while todo > 0:
            room = most_slots - used - drawn
            chance = np.where(room > 0, np.maximum(want - used, 0), 0).astype(float)
            chance = chance if chance.any() else np.maximum(room, 0).astype(float)
            got = np.minimum(rng.multinomial(todo, chance / chance.sum()), room)
            drawn, todo = drawn + got, todo - int(got.sum())
        rows += [(shard, int(k), int(used[k]), int(drawn[k])) for k in np.flatnonzero(drawn)]
        used += drawn
    return rows


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block_words=BLOCK_WORDS, shards=OUTPUT_SHARDS,
    weights=WEIGHTS, most=MAX_REPEATS, seed=SEED, draw_seed=DRAW_SEED, buckets=BUCKETS, rid_col=None):
    """``(offsets, slots, per_source)``. ``rid_col`` names a unique long column of ``docs``; without it rows are numbered.

    ``offsets``: each row's ``doc_id, rid, source, size, sid, first_word`` - the words of a source are laid end to
    end in a hashed order. ``slots``: ``sid, shard, slot, block`` - what each output slot holds. ``per_source``:
    ``sid, source, source_size, target, blocks, slots`` (a row for each source, MAX_SOURCES at most). ``seed`` keys the
    permutations, ``draw_seed`` the draw.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"),
        F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    # Rows of one id, null among them, are spread by their texts.
    rows = written(rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(buckets)).cast("int")), "mix-rows")
    sums = written(rows.groupBy("source", "b").agg(F.sum("size").alias("words")), "mix-sums")
    sizes = [(r.source, int(r.words)) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()]
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = targets(sizes, weights, most)
    blocks, wanted, ordered = [], [], sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    for source, words in ordered:
        blocks.append(-(-words // block_words))
        wanted.append(min(round(want[source] * blocks[-1] / words), math.floor(most * blocks[-1])) if words else 0)
    runs = draw_slots(blocks, wanted, shards, draw_seed, most)
    given = [0] * len(blocks)
    for _, sid, _, n in runs:
        given[sid] += n
    per_source = [(sid, source, words, float(want[source]), blocks[sid], given[sid]) for sid, (source, words) in enumerate(ordered)]
    per_source_df = spark.createDataFrame(per_source, "sid int, source string, source_size long, target double, blocks long, slots long")

    prior = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s_source"), F.col("b").alias("s_b"), F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "b").orderBy("doc_id", "text_hash", "rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("b") == F.col("s_b")))
        .join(F.broadcast(per_source_df.select("sid", F.col("source").alias("p_source"))), F.col("source").eqNullSafe(F.col("p_source")))
        .select("doc_id", "rid", "source", "size", "sid", (F.col("start") + F.col("inner")).alias("first_word"))
    )
    offsets = written(offsets, "mix-offsets")
    release(rows, sums)

    total = sum(given)
    ends = np.cumsum([n for *_, n in runs])
    pieces = -(-total // PIECE)

    def place(batches):
        for pdf in batches:
            for piece in pdf["id"]:
                at = np.arange(piece * PIECE, min((piece + 1) * PIECE, total), dtype=np.int64)
                run = np.searchsorted(ends, at, side="right")
                shard, sid, first, n = (np.array(x, np.int64) for x in zip(*runs[run[0] : run[-1] + 1]))
                of = run - run[0]
                slot = first[of] + at - (ends[run] - n[of])
                sid, size = sid[of], np.array(blocks, np.int64)[sid[of]]
                block = permuted(slot % size, size, slot // size + np.int64(seed) + sid * 1_000_003)
                yield pd.DataFrame({"sid": sid.astype(np.int32), "shard": shard[of].astype(np.int32), "slot": slot, "block": block})

    parts = max(1, min(pieces, spark.sparkContext.defaultParallelism * 4))
    slots = spark.range(0, pieces, 1, parts).mapInPandas(place, "sid int, shard int, slot long, block long")
    return offsets, slots, per_source_df


def blocks_of(offsets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``rid, doc_id, sid, block, start, words``: the stretches of each document (0-based first word, length) by block."""
    first, last = F.floor(F.col("first_word") / block_words), F.floor((F.col("first_word") + F.col("size") - 1) / block_words)
    each = offsets.where("size > 0").select("doc_id", "rid", "sid", "size", "first_word", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block_words, F.col("first_word"))
    end = F.least((F.col("block") + 1) * block_words, F.col("first_word") + F.col("size"))
    return each.select("doc_id", "rid", "sid", "block", (begin - F.col("first_word")).alias("start"), (end - begin).alias("words"))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, shards``.

    ``taken`` counts the words that the mix takes of the row, repeats included: at most ``most`` times its size,
    as each epoch of slots takes a block once. ``shards`` lists the output shards that hold some of them, ascending
    and comma-joined. Null text has no words; null source is a source of its own, last; repeated rows are rows of
    their own; an empty table gives no rows; other columns are not read. Texts of any length are counted by the engine.
    Same input, same seeds, same result.
    """
    bound_arrow_batches(docs.sparkSession)
    block_words = options.get("block_words", BLOCK_WORDS)
    offsets, slots, per_source = mix_plan(docs, **options)
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("held_by"))
    taken = blocks_of(offsets, block_words).join(times.hint("merge"), ["sid", "block"])
    taken = taken.groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("held_by")))).alias("held_by"))
    return (
        offsets.join(taken.hint("merge"), "rid", "left")
        .join(F.broadcast(per_source.select("sid", "source_size", "target")), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.concat_ws(",",
            F.col("held_by").cast("array<string>")).alias("shards"))
    )


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", shard_column: str | None = None, **options) -> DataFrame:
    """The mix as documents, with all columns of ``docs``: a row for each pass over a document, its text cut to the
    stretches that this pass takes. With ``shard_column``, that column names the output shard, and each shard has
    rows of its own. A whole document keeps its text as it is; stretches keep the white space inside them and are
    joined by a line feed. Documents with nothing taken go. ``n_chars``, if there, is counted anew. Rows are
    numbered once and joined by that number, so rows with a null or a repeated id are rows of their own; null and
    blank texts have no words and go; an empty table gives no rows."""
    bound_arrow_batches(docs.sparkSession)
    block_words = options.get("block_words", BLOCK_WORDS)
    rid, runs_col = fresh_names(docs, "rid", "runs")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    offsets, slots, _ = mix_plan(numbered, id_col=id_col, text_col=text_col, rid_col=rid, **options)
    by = ["sid", "block"] + ["shard"] * bool(shard_column)
    times = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("times"))
    runs = (
        blocks_of(offsets, block_words).join(times.hint("merge"), ["sid", "block"])
        .groupBy(F.col("rid").alias(rid), *by[2:]).agg(F.sort_array(F.collect_list(F.struct("start", "words", "times"))).alias(runs_col))
    )
    if shard_column:
        if shard_column in docs.columns:
            raise ValueError(f"there is a column {shard_column} already")
        runs = runs.withColumnRenamed("shard", shard_column)
        docs = docs.withColumn(shard_column, F.lit(0))
    joined = numbered.join(runs.hint("merge"), rid).select(*docs.columns, runs_col)
    schema = docs.schema
    names, at, runs_at = docs.columns, docs.columns.index(text_col), len(docs.columns)

    def cut(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts, rows, out = batch.column(at).to_pylist(), [], []
            for i, (t, stretches) in enumerate(zip(texts, batch.column(runs_at).to_pylist())):
                spans = [m.span() for m in word.finditer(t or "")]
                for turn in range(1, max(s["times"] for s in stretches) + 1):
                    merged: list[list[int]] = []
                    for s in stretches:
                        if s["times"] >= turn and s["words"]:
                            if merged and merged[-1][1] == s["start"]:
                                merged[-1][1] += s["words"]
                            else:
                                merged.append([s["start"], s["start"] + s["words"]])
                    if merged == [[0, len(spans)]]:
                        rows.append(i)
                        out.append(t)
                    elif merged:
                        rows.append(i)
                        out.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in merged))
            taken = batch.select(names).take(pa.array(rows, pa.int64()))
            columns = [pa.array(out, pa.string()) if k == at else taken.column(k) for k in range(len(names))]
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in out], columns[k].type)
            yield pa.record_batch(columns, names=names)

    return joined.mapInArrow(cut, schema)
