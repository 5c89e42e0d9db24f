"""Byte-level BPE encoding and decoding.

A long text is cut into overlapping chunks that are pre-tokenised in parallel. Pre-tokens that end before their
chunk's end are exact for the position they were matched from, so the chunks are stitched where the running
boundary is also a boundary of the next chunk; only then are the pieces encoded. Decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
#: A match may be decided by this many characters after it (contractions, the white-space look-ahead), so matches
#: that end nearer to a cut are left to the next chunk.
LOOKAHEAD_CHARS = 8
CACHED_PIECES = 1 << 17
CACHED_CHARS = 24
#: Vocabularies are shipped to the executors, so their files must be small.
MAX_RANKS_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class _Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, encode_piece):
        super().__init__()
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.encode_piece(piece)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """One vocabulary and pre-token pattern. The pattern must not look behind a match's start, nor further ahead of
    its end than LOOKAHEAD_CHARS; the library merges the bytes of each piece."""

    def __init__(self, ranks_data: bytes, pattern: str):
        self.ranks = parse_ranks(ranks_data)
        self.pattern = regex.compile(pattern)
        library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = _Pieces(library.encode_ordinary)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    def encode_pieces(self, pieces) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(m.group() for m in self.pattern.finditer(text)) if self.pattern.groups else self.encode_pieces(self.pattern.findall(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def boundaries(self, chunk: str, start: int, last: bool) -> np.ndarray:
        """Rows ``(start, end)`` of the pre-tokens of a chunk, in the text's code points; the ones at the
        end of a chunk that isn't the last may go on, and are left out."""
        spans = [m.span() for m in self.pattern.finditer(chunk)]
        while spans and not last and spans[-1][1] > len(chunk) - LOOKAHEAD_CHARS:
            spans.pop()
        return np.array(spans, np.int64).reshape(-1, 2) + start

    def stitch(self, text: str, chunks: list[np.ndarray]) -> Iterator[str]:
        """The text's pre-tokens from its chunks' boundaries. Where a chunk does not have the running boundary,
        as inside a pre-token longer than the overlap, matching goes on from there until one of its boundaries agrees."""
        at = 0
        for spans in chunks:
            starts, ends = spans[:, 0].tolist(), spans[:, 1].tolist()
            while ends and at < ends[-1]:
                if at == starts[0] or (k := bisect_left(ends, at)) < len(ends) and ends[k] == at:
                    first = 0 if at == starts[0] else k + 1
                    yield from (text[a:b] for a, b in zip(starts[first:], ends[first:]))
                    at = ends[-1]
                    break
                m = self.pattern.search(text, at)
                if m is None:
                    return
                yield m.group()
                at = m.end()
        for m in self.pattern.finditer(text, at):
            yield m.group()


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec a Python worker and vocabulary."""
    key = (hash(shared.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decode: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers in a binary); with
    ``decode`` also ``decoded``, the ids' bytes, made by the same workers.

    Texts of one chunk are encoded where they are read. Longer ones are cut, their chunks dealt out and
    pre-tokenised in parallel, then stitched and encoded by document. Null text counts as empty and has no
    tokens; repeated rows stay rows of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    step = chunk_chars
    schema = ENCODED + (", decoded binary" if decode else "")
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decode

    def whole(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            more = [pa.array([codec.decode(x) for x in ids], pa.binary())] if decode else []
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *more], names)

    def cut(batches):
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                starts = range(0, len(text), step)
                yield pa.record_batch(
                    [
                        pa.array([rid] * len(starts), pa.int64()), pa.array([doc_id] * len(starts), pa.int64()), pa.array(list(starts), pa.int64()),
                        pa.array([s + step + overlap_chars >= len(text) for s in starts], pa.bool_()),
                            pa.array([text[s : s + step + overlap_chars] for s in starts], pa.string()),
                    ],
                    ["rid", "doc_id", "start", "last", "chunk"],
                )

    def split(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            got = [codec.boundaries(c, s, last).astype("<i8").tobytes() for s, last, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            core = [c if last else c[:step] for last, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(core, pa.string()),
                pa.array(got, pa.binary())], ["rid", "doc_id", "start", "last", "core", "spans"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(shared, pattern)
        pdf = pdf.sort_values("start")
        first_last = int(np.argmax(pdf["last"].to_numpy()))  # later chunks lie inside the overlap of this one
        pdf = pdf.iloc[: first_last + 1]
        spans = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in pdf["spans"]]
        ids = codec.encode_pieces(codec.stitch("".join(pdf["core"]), spans))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n_tokens": [len(ids) // 4],
            "ids": [ids]} | ({"decoded": [codec.decode(ids)]} if decode else {}))

    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, schema)
    chunks = (
        rows.where(F.length("text") > chunk_chars)
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        .mapInArrow(cut, "rid long, doc_id long, start long, last boolean, chunk string")
        .repartition("rid", "start")
        .mapInArrow(split, "rid long, doc_id long, start long, last boolean, core string, spans binary")
    )
    long = chunks.groupBy("rid").applyInPandas(join, schema)
    return short.unionByName(long)


def decode_tokens(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of ``encoded`` and a column ``decoded`` (binary) more: the tokens' bytes, joined; no
    ids, no bytes. Null ids and repeated rows stay rows; an empty table gives no rows; other columns are left out."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            out = [codec.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, ENCODED + ", decoded binary")


def default_vocabulary() -> tuple[str, str]:
    """``(ranks path, pattern)`` of the installed multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_and_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` by encoding every text and decoding its ids again. Null and
    empty texts have no tokens; null ids and repeated rows stay rows of their own; an empty table gives no rows."""
    decoded = encode_texts(docs, ranks_path, pattern, id_col, text_col, decode=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
