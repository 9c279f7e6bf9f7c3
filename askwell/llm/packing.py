"""Sequences of at most ``length`` tokens, filled along a Hilbert curve through hashed document vectors.

A document's token counts are hashed into a few hundred dimensions and projected to ``DIMS`` by a fixed random matrix.
The direction of the projection is a cell of a grid, its place on the Hilbert curve the document's key. Documents are
range-sorted by key and laid end to end; every ``length`` tokens a sequence ends. What is left at the end of a range
is cut into powers of two, which need no padding. So a range of any size has no padding at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import cut, mix, written
from askwell.llm.tokens import encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH, END = 2048, 1
DIMS, BITS, BUCKETS = 4, 12, 512
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def projection(ids: int) -> np.ndarray:
    """A vector for each token id: the row of a fixed random matrix for the id's hash."""
    matrix = np.random.default_rng(20041).standard_normal((BUCKETS, DIMS))
    return matrix[(mix(np.arange(ids, dtype=np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)]


def cells(vectors: np.ndarray) -> np.ndarray:
    """Grid cells of the vectors' directions; a vector of nothing is in the middle."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    return np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points of a grid with ``2 ** bits`` cells a side, by Skilling's transform."""
    x = grid.T.astype(np.int64).copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, key, ids``: place on the curve and token ids, two bytes each, written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(path)
        vectors = projection(1 << 16)
        for batch in batches:
            done = 0
            for part in cut(batch.column("text")):
                ids, counts = encode_texts(part.to_pylist())
                of = np.repeat(np.arange(len(counts)), counts)
                sums = np.stack([np.bincount(of, weights=vectors[ids, d], minlength=len(counts)) for d in range(DIMS)], axis=1).astype(np.float64)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int64) * 2
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                doc_ids = batch.column("doc_id").slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(hilbert_keys(cells(sums))), packed.cast(pa.binary())], ["doc_id", "key", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, f"doc_id {kind}, key bigint, ids binary"), "tokens")


def laid_out(rows: Iterator[tuple], first: int, length: int) -> Iterator[list[tuple]]:
    """Pieces ``(doc_id, start, length, crc32, doc_tokens, sequence_id, offset)`` of documents ``(doc_id, ids)`` in order,
    a list for each sequence or more. Holds one open sequence at a time."""
    sequence, room, open_pieces = first, length, []

    def close(pieces: list[tuple], number: int) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids), zlib.crc32(ids), total, number, offset))
            offset += len(ids)
        return out

    for doc_id, ids in rows:
        at = 0
        while at < len(ids):
            piece = ids[at : at + room]
            open_pieces.append((doc_id, at, piece, len(ids)))
            at += len(piece)
            room -= len(piece)
            if not room:
                yield close(open_pieces, sequence)
                sequence, room, open_pieces = sequence + 1, length, []
    left = length - room
    while left:  # the rest as powers of two
        room, taken = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc_id, start, ids, total = open_pieces.pop(0)
            taken.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                open_pieces.insert(0, (doc_id, start + room, ids[room:], total))
            room -= len(taken[-1][2])
        yield close(taken, sequence)
        sequence += 1


def packed(docs: DataFrame, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty text: the end id alone. A text of any length goes over as many sequences as it takes. Copies share a
    key and are put in order of id, so a large group of them still spreads over ranges; repeated rows are packed each.
    An empty table gives no piece. Other columns are not looked at.
    """
    tokens = encoded(docs, vocabulary_path(VOCABULARY, folder))
    ranged = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", F.crc32("ids"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_kind: list = []

        def rows():
            for batch in batches:
                arrow_kind[:] = [batch.schema.field("doc_id").type]
                for part_start in range(0, batch.num_rows, 256):
                    part = batch.slice(part_start, 256)
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                        yield doc_id, np.append(np.frombuffer(ids, dtype="<u2"), END).astype("<u4")

        gathered: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*gathered))
            gathered.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow_kind[0]), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for pieces in laid_out(rows(), TaskContext.get().partitionId() << 40, length):
            gathered.extend(pieces)
            if len(gathered) >= 10_000:
                yield table()
        if gathered:
            yield table()

    return ranged.select("doc_id", "ids").mapInArrow(pack, f"doc_id {kind}, {PIECES}")
