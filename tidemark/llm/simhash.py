"""SimHash near-duplicate detection by pigeonhole blocks: fingerprints are split so that close pairs share blocks,
joined on the blocks, and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, fresh_names, release, written
from tidemark.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42
#: A bucket with more fingerprints than this is split by blocks of its other bits before any pair is formed.
LARGE_BUCKET = 1024
#: A group that one task compares pair by pair holds at most this many fingerprints; larger ones are split again.
DIRECT = 4096
_SLICE = 1 << 15


def shingle_hashes(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned XXH64 of each run of ``size`` words, joined by a space; of all words, if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    joined = map(b" ".join, runs)
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(HASH_SEED)), np.uint64, max(1, len(words) - size + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 where over half of the hashes have it; no hashes, zero."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[a : a + _SLICE]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of each row: whole texts, A-Z lower-cased, split at ASCII white space."""
    bound_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [fingerprint(shingle_hashes((t or b"").lower().split(), shingle_words)) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of ``parts`` near-equal blocks of ``n_bits`` bits."""
    edges = [round(i * n_bits / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(max_distance: int) -> list[int]:
    """Bit masks such that two fingerprints within the distance agree on all bits of at least one mask: with
    ``max_distance + 2`` blocks at least two are untouched, so each pair of blocks is a mask."""
    return pair_masks(max_distance + 2)


def pair_masks(n_blocks: int) -> list[int]:
    cut = blocks(64, n_blocks)
    masks = [((1 << w) - 1) << s for s, w in cut]
    return [a | b for a, b in combinations(masks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near_pairs(group: np.ndarray, fp: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i, j`` of rows of one group (groups are runs) within the distance."""
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= max_distance
        yield at[near], at[near] + step
        step += 1


def _merge(root: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining the pairs ``i, j``; the root of a component is its member of lowest rank."""
    if len(i):
        for a, b in np.unique(np.stack([root[i], root[j]], axis=1), axis=0).tolist():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                low, high = (a, b) if rank[a] <= rank[b] else (b, a)
                root[high] = low
        while (root[root] != root).any():
            root = root[root]
    return root


def local_links(group: np.ndarray, fp: np.ndarray, node: np.ndarray, max_distance: int = MAX_DISTANCE, verify=None,
    direct: int | None = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """Links ``node -> smallest node`` of the components that near pairs form within each group (groups are runs): as
    many as rows at most, however many pairs there are. ``verify(i, j)`` may turn pairs down. Groups beyond
    ``direct`` are split by blocks of the bits that vary in them."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.flatnonzero(np.repeat(sizes <= (direct or len(group)), sizes))
    root, rank = np.arange(len(fp)), np.argsort(np.argsort(node, kind="stable"), kind="stable")
    for i, j in _near_pairs(group[small], fp[small], max_distance):
        i, j = small[i], small[j]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if verify is not None and len(i):
            fine = verify(i, j)
            i, j = i[fine], j[fine]
        root = _merge(root, rank, i, j)
    moved = root != np.arange(len(root))
    a_all, b_all = [node[moved]], [node[root[moved]]]
    for k in np.flatnonzero(sizes > direct) if direct else ():
        f, n = fp[starts[k] : starts[k] + sizes[k]], node[starts[k] : starts[k] + sizes[k]]
        varying = [b for b in range(64) if ((f >> np.uint64(b)) & np.uint64(1)).any() and not ((f >> np.uint64(b)) & np.uint64(1)).all()]
        for shift, width in blocks(len(varying), max_distance + 1):
            key = f & np.uint64(sum(1 << b for b in varying[shift : shift + width]))
            order = np.argsort(key, kind="stable")
            a, b = local_links(key[order], f[order], n[order], max_distance)
            a_all.append(a)
            b_all.append(b)
    return np.concatenate(a_all), np.concatenate(b_all)


def _whole_buckets(batches, n_keys: int):
    """Columns (as arrays) of successive batches of rows sorted by their first ``n_keys`` columns, cut so that no
    bucket is torn; and the number of each row's bucket. The parts of a bucket are joined once, at its end."""
    held: list[list[np.ndarray]] = []

    def numbered(parts):
        cols = [np.concatenate(c) for c in zip(*parts)]
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new), cols

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        same = np.ones(len(cols[0]), bool)  # rows of the last bucket wait: it may go on in the next batch
        for c in cols[:n_keys]:
            same &= c == c[-1]
        last = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        goes_on = bool(held) and all(h[0] == c[0] for h, c in zip(held[0][:n_keys], cols))
        if held and (last or not goes_on):
            yield numbered(held + ([[c[:last] for c in cols]] if last else []))
            held = []
        elif last:
            yield numbered([[c[:last] for c in cols]])
        held.append([c[last:] for c in cols])
    if held:
        yield numbered(held)


def near_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """Links ``a, b`` between the nodes of distinct fingerprints (columns ``node, fp``): their components are those
    of all pairs within the distance."""
    masks = block_keys(max_distance)
    rows = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    large = written(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large_bucket).select("t", "key",
        F.lit(True).alias("large")), "simhash-large")
    rest = []
    for m in masks:
        other = [b for b in range(64) if not m >> b & 1]
        rest.append([_signed(sum(1 << b for b in other[s : s + w])) for s, w in blocks(len(other), max_distance + 1)])
    sub = F.lit(None).cast("array<bigint>")
    for t, parts in enumerate(rest):
        sub = F.when(F.col("t") == t, F.array(*[F.col("fp").bitwiseAND(F.lit(p)) for p in parts])).otherwise(sub)
    split = (
        rows.join(large.hint("merge"), ["t", "key"], "left")
        .select("t", "key", "node", "fp", F.posexplode(F.when(F.col("large"), sub).otherwise(F.array(F.lit(0).cast("long")))).alias("u", "sub"))
        .repartition("t", "key", "u", "sub")
        .sortWithinPartitions("t", "key", "u", "sub")
    )

    def link(batches):
        for group, cols in _whole_buckets(batches, 4):
            a, b = local_links(group, cols[4].astype(np.int64).view(np.uint64), cols[5].astype(np.int64), max_distance)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return split.select("t", "key", "u", "sub", "fp", "node").mapInArrow(link, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``, the smallest id reachable over links of fingerprints
    within the distance.

    Equal fingerprints are one node from the start, so groups of copies cost one row. Null and blank texts have
    fingerprint zero and link like any other; rows with a null id link to nothing and have a null component;
    repeated rows stay rows of their own; an empty table gives no rows; other columns are ignored. A text of any
    length is read whole, by the task that reads it.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = connected_components(near_links(nodes, max_distance))
    label = nodes.join(found, "node", "left").select(F.col("fp"), F.coalesce("component", "node").alias("component_id"))
    label = written(label, "simhash-labels")
    out = prints.join(label.hint("merge"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of :func:`near_components` at its production parameters."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by words: the form that the corpus pipeline uses.

TEXT_SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Tables of a signature and MinHash values in a table's key. Two texts of Jaccard similarity s over their shingles
#: share a key with probability 1 - (1 - s ** KEY_VALUES) ** TABLES, however they differ: 1 - 3e-6 at 0.8.
TABLES = 24
KEY_VALUES = 4
#: Signatures that agree by less than this under the similarity asked for are not compared exactly: a pair at 0.8
#: falls below it with a probability of 1e-6.
SLACK = 0.2
#: A group of candidates is decided in one task up to so many sets and bytes; else by representatives, one a round,
#: and then in blocks of so many sets and bytes.
GROUP_SETS = 512
#: Nodes of a key whose signatures one task compares; larger keys are tied to their smallest node, row by row.
KEY_NODES = 256
GROUP_BYTES = 64 << 20
REPRESENTATIVES = 4
BLOCK_SETS = 512
BLOCK_BYTES = 16 << 20
_HASHES = TABLES * KEY_VALUES
_FLIP, _FACTOR = (np.random.Generator(np.random.PCG64(HASH_SEED)).integers(0, 1 << 64, (2, _HASHES, 1), np.uint64))
_FACTOR = _FACTOR | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles: A-Z lower-cased, split at ASCII white space."""
    return np.unique(shingle_hashes((text or b"").lower().split(), TEXT_SHINGLE_WORDS))


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each of ``_HASHES`` MinHash values of a set that isn't empty."""
    least = np.full((_HASHES, 1), np.uint64((1 << 64) - 1))
    for a in range(0, len(hashes), 2048):
        part = (hashes[None, a : a + 2048] ^ _FLIP) * _FACTOR
        least = np.minimum(least, part.min(axis=1, keepdims=True))
    return (_mixed(least[:, 0]) >> np.uint64(48)).astype("<u2")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def exact_links(sets: list[np.ndarray], node: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For each set the smallest node of its component, over pairs of sets whose Jaccard similarity is ``least`` or
    more, by intersection: every pair is counted, save those already joined over others."""
    sizes = np.array([len(x) for x in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    root, rank = np.arange(len(sets)), np.argsort(np.argsort(node, kind="stable"), kind="stable")
    mine = np.zeros(len(values), bool)
    later = np.arange(len(sets))
    for i in range(len(sets)):
        j = later[i + 1 :]
        j = j[(root[j] != root[i]) & (np.minimum(sizes[j], sizes[i]) + 1e-9 >= least * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        mine[own] = True
        shared = np.array([np.count_nonzero(mine[ids[ends[k] - sizes[k] : ends[k]]]) for k in j.tolist()])
        mine[own] = False
        j = j[shared + 1e-9 >= least * (sizes[i] + sizes[j] - shared)]
        root = _merge(root, rank, np.full(len(j), i), j)
    return node[root]


class _Shared:
    """How many values a set shares with each of some sets, by one look-up of its values."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.values, self.first = np.unique(every[order], return_index=True)
        self.last = np.r_[self.first[1:], len(every)]

    def alike(self, x: np.ndarray, least: float) -> np.ndarray:
        """Numbers of the sets whose Jaccard similarity with ``x`` is ``least`` or more."""
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        first, n = self.first[at], self.last[at] - self.first[at]
        owners = self.owner[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else at
        shared = np.bincount(owners, minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (shared + 1e-9 >= least * (self.sizes + len(x) - shared)))


def _hashes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8").astype(np.uint64, copy=False)


def _table_keys(batches):
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
        t, node = np.tile(np.arange(TABLES, dtype=np.int32), batch.num_rows), np.repeat(batch.column(0).to_numpy(), TABLES)
        yield pa.record_batch([pa.array(t), pa.array(keys), pa.array(node)], ["t", "key", "node"])


def met_nodes(nodes: DataFrame) -> DataFrame:
    """``t, key, node, n, first`` of the keys that several nodes (columns ``node, sig``) share, with their number and
    the smallest of them."""
    tables = written(nodes.select("node", "sig").mapInArrow(_table_keys, "t int, key long, node long"), "near-tables")
    shared = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = written(shared, "near-shared")  # as a table of its own, so that the join can split a hot key
    met = written(tables.join(shared.hint("merge"), ["t", "key"]), "near-buckets")
    release(tables, shared)
    return met


def candidate_links(met: DataFrame, nodes: DataFrame, similarity: float, large_bucket: int = KEY_NODES) -> DataFrame:
    """Links ``a, b`` between nodes that share a table's key. In buckets of ``large_bucket`` nodes or less only where
    signatures agree too; larger ones are tied to their smallest node as they are, row by row, so that no task holds
    them."""
    enough = int(np.floor((similarity - SLACK) * _HASHES))
    hubs = met.where((F.col("n") > large_bucket) & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"),
        F.col("first").alias("b")).distinct()
    sides = met.where(F.col("n") <= large_bucket).select("t", "key", "node").join(nodes.select("node", "sig").hint("merge"), "node")

    def link(batches):
        for group, (_, _, node, sigs) in _whole_buckets(batches, 2):
            s = np.frombuffer(b"".join(sigs.tolist()), "<u2").reshape(-1, _HASHES)
            alike = lambda i, j: (s[i] == s[j]).sum(axis=1) >= enough
            a, b = local_links(group, np.zeros(len(node), np.uint64), node.astype(np.int64), 64, alike, None)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = sides.select("t", "key", "node", "sig").repartition("t", "key").sortWithinPartitions("t", "key")
    return rows.mapInArrow(link, "a long, b long").unionByName(hubs)


def print_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``a, b`` that tie all nodes (columns ``node, fp``) whose SimHash fingerprints differ in ``max_distance`` bits or
    less, directly or over others. Nodes of one fingerprint are tied to its smallest."""
    distinct = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    equal = nodes.select("node", "fp").join(distinct.hint("merge"), "fp").where("node <> first").select(F.col("node").alias("a"),
        F.col("first").alias("b"))
    return equal.unionByName(near_links(distinct.select(F.col("first").alias("node"), "fp"), max_distance))


def _decide_groups(similarity: float):
    """Links of each group's sets, the group held in one task."""

    def settled(sets, node):
        nodes = np.array(node, np.int64)
        return pa.record_batch([pa.array(nodes), pa.array(exact_links(sets, nodes, similarity))], ["a", "b"])

    def run(batches):
        group, sets, node = None, [], []
        for batch in batches:
            for component, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if component != group and sets:
                    yield settled(sets, node)
                    sets, node = [], []
                group = component
                sets.append(_hashes(packed))
                node.append(n)
        if sets:
            yield settled(sets, node)

    return run


def _against_first(similarity: float):
    """Each set against its group's first one: the first one's node where they are alike, else the set once more."""

    def run(batches):
        group, first = None, None
        for batch in batches:
            out = []
            for component, node, packed, weight, rep, rep_set in zip(*(c.to_pylist() for c in batch.columns)):
                if component != group:
                    group, first = component, _Shared([_hashes(rep_set)])
                alike = len(first.alike(_hashes(packed), similarity)) > 0
                out.append((component, node, None if alike else packed, weight, rep if alike else None))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["component", "node",
                "set", "weight", "rep"])

    return run


def _meet_cells(similarity: float):
    """Links between the two sides of each cell: side 0, which is held, and side 1, which passes by."""

    def run(batches):
        cell, held, nodes, shared = None, [], [], None
        for batch in batches:
            a, b = [], []
            for component, ab, rb, side, node, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, ab, rb) != cell:
                    cell, held, nodes, shared = (component, ab, rb), [], [], None
                if side == 0:
                    held.append(_hashes(packed))
                    nodes.append(node)
                elif held:
                    shared = shared or _Shared(held)
                    found = [nodes[k] for k in shared.alike(_hashes(packed), similarity).tolist()]
                    a += found
                    b += [node] * len(found)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks_of(sets: DataFrame, name: str) -> DataFrame:
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES))
    return sets.groupBy("component").agg(n.cast("int").alias(name))


def large_group_links(sets: DataFrame, similarity: float, rounds: int = REPRESENTATIVES) -> DataFrame:
    """Links ``a, b`` that give the components of all pairs of alike sets in each group (columns ``component, node,
    set, weight``), with no group in one task.

    In each of some rounds the sets of a group that are left meet the one of largest weight; those alike are its
    circle. Pairs inside a circle are linked over its representative; all sets outside the largest circle meet all
    sets of their group, block by block.
    """
    rest, circles = sets, None
    for step in range(rounds):
        first = rest.groupBy("component").agg(F.max(F.struct("weight", "node", "set")).alias("first")).select("component",
            F.col("first.node").alias("rep"), F.col("first.set").alias("rep_set"))
        first = written(first, f"near-first-{step}")
        pairs = rest.join(first.hint("merge"), "component").select("component", "node", "set", "weight", "rep", "rep_set")
        met = written(pairs.mapInArrow(_against_first(similarity), "component long, node long, set binary, weight long, rep long"),
            f"near-round-{step}")
        found = met.where("rep is not null").select("component", "node", "rep")
        circles = found if circles is None else circles.unionByName(found)
        rest = met.where("rep is null").select("component", "node", "set", "weight")
        if rest.isEmpty():
            break
    sizes = circles.groupBy("component", "rep").agg(F.count(F.lit(1)).alias("n"))
    largest = written(sizes.groupBy("component").agg(F.max_by("rep", F.struct("n", "rep")).alias("largest")), "near-largest")
    inside = circles.join(largest.hint("merge"), "component").where("rep = largest").select("node")
    links = circles.select(F.col("node").alias("a"), F.col("rep").alias("b"))
    sets = sets.select("component", "node", "set")
    rest = written(sets.join(inside.hint("merge"), "node", "left_anti").select("component", "node", "set"), "near-outside")
    if rest.isEmpty():
        return links
    both = written(_blocks_of(rest, "n_rest").join(_blocks_of(sets, "n_all"), "component"), "near-blocks")

    def dealt(side, rows, own, other, n_own, n_other):
        rows = rows.join(both.hint("merge"), "component").withColumn(own, F.pmod(F.xxhash64("node"), F.col(n_own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("component", "ab", "rb",
            F.lit(side).alias("side"), "node", "set")

    cells = dealt(0, rest, "rb", "ab", "n_rest", "n_all").unionByName(dealt(1, sets, "ab", "rb", "n_all", "n_rest"))
    order = ["component", "ab", "rb"]
    return links.unionByName(cells.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_meet_cells(similarity), "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    group_sets: int = GROUP_SETS, large_bucket: int = KEY_NODES) -> DataFrame:
    """``doc_id, component_id`` of each row that has words: its near copies are the texts whose sets of five-word
    shingles (A-Z lower-cased, white space as single spaces) have a Jaccard similarity of ``similarity`` or more with
    its own, directly or over others.

    SimHash fingerprints of the shingles, near by pigeonhole blocks and verified Hamming distance as in
    :func:`near_components`, and MinHash tables, for pairs whose fingerprints are further apart, find groups of
    candidates; within a group the sets themselves decide, in one task up to ``group_sets`` sets and GROUP_BYTES, beyond that in parts. Rows of equal sets are one node. Blank texts
    are not near anything; null ids neither; an empty table gives no rows.
    """
    bound_arrow_batches(docs.sparkSession)

    def prints(batches):
        for batch in batches:
            digests, signatures, prints = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingle_set(text.as_py())
                prints.append(fingerprint(hashes) if len(hashes) else None)
                digests.append(set_digest(hashes) if len(hashes) else None)
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(prints,
                pa.int64())], ["doc_id", "digest", "sig", "fp"])

    def as_sets(batches):
        """Sets of the nodes; a row whose set isn't that of the digest is another row of the same id."""
        for batch in batches:
            out = []
            for component, node, digest, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary())):
                hashes = shingle_set(text.as_py())
                if set_digest(hashes) == digest:
                    out.append((component, node, hashes.astype("<u8").tobytes()))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 3,
                (pa.int64(), pa.int64(), pa.binary()))], ["component", "node", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = written(rows.mapInArrow(prints, "doc_id long, digest binary, sig binary, fp long").where("digest is not null"), "near-prints")
    nodes = written(found.groupBy("digest", "sig", "fp").agg(F.min("doc_id").alias("node")), "near-nodes")
    met = met_nodes(nodes)
    candidates = candidate_links(met, nodes, similarity, large_bucket).unionByName(print_links(nodes))
    linked = connected_components(written(candidates, "near-candidates"))
    grouped = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    members = written(nodes.join(grouped.hint("merge"), "node").select("component", F.col("node").alias("member"), "digest"), "near-members")
    texts = rows.join(members.hint("merge"), F.col("doc_id") == F.col("member")).select("component", "doc_id", "digest", "text")
    sets = written(texts.mapInArrow(as_sets, "component long, node long, set binary"), "near-sets")
    beyond = (F.count(F.lit(1)) > group_sets) | (F.sum(F.octet_length("set")) > GROUP_BYTES)
    sizes = written(sets.groupBy("component").agg(beyond.alias("large")), "near-sizes")
    by_component, sets = sets, written(sets.join(sizes.hint("merge"), "component"), "near-groups", partition_by="large")
    release(by_component, sizes)
    small, large = (sets.where(which).select("component", "node", "set") for which in ("not large", "large"))
    links = small.repartition("component").sortWithinPartitions("component").mapInArrow(_decide_groups(similarity), "a long, b long")
    if not large.isEmpty():  # who shares many keys is a text that others were made from, and speaks for most
        weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
        links = links.unionByName(large_group_links(large.join(weights.hint("merge"), "node"), similarity))
    linked = connected_components(written(links, "near-links"))
    label = written(nodes.join(linked.hint("merge"), "node", "left").select("digest", F.coalesce("component",
        "node").alias("component_id")), "near-labels")
    release(nodes, members, met, sets)
    return found.select("doc_id", "digest").join(label.hint("merge"), "digest").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of each group of near copies the
    one with the smallest id. Rows of one id stay or go together; blank texts and null ids stay; an empty table gives
    no rows."""
    (gone_id,) = fresh_names(docs, "gone_id")
    gone = near_copies(docs, id_col, text_col, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
