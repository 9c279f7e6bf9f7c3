"""Approximate search by product quantisation: a vector is kept as one byte for each ``PART`` of its dimensions.

Each part of a vector is replaced by the nearest of 256 codewords of that part. A question's distances to all codewords of
all parts are a small table; a row's distance is a sum of table entries, so the scan reads codes only, 1/16 of the vectors'
bytes. Every row has a code and is looked at. The ``rerank`` best rows of each question are then scored with their
vectors. Codewords are fitted to a bounded sample of rows (``sample``), the rows with the smallest hashes of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.vectors import l2
from askwell.operators.blocks import MATRIX_ENTRIES, block_search
from askwell.operators.nearest import DIGITS, EACH, matrix, near_pairs
from askwell.operators.ranking import top_k

PART, WORDS = 4, 256
SAMPLE = 8192
RERANK = 10  # rows scored with their vectors, for each one that is wanted, of so many rows:
RERANK_OF, RERANK_GROWTH = 10_000, 0.4  # codes tell fewer of the nearest apart as rows get denser


def split(vectors: np.ndarray, part: int = PART) -> np.ndarray:
    """Rows x parts x dimensions of a part; missing dimensions are 0."""
    n, dims = vectors.shape
    short = -dims % part
    return np.pad(vectors, ((0, 0), (0, short))).reshape(n, (dims + short) // part, part)


def codewords(points: np.ndarray, words: int, rounds: int, seed: int) -> np.ndarray:
    """K-means centres of points, ``words`` of them; of few points, the points themselves over again."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(np.arange(max(words, len(points))) % len(points))[:words]]
    for _ in range(rounds):
        nearest = assigned(points, centres)
        counts = np.bincount(nearest, minlength=words)
        sums = np.stack([np.bincount(nearest, weights=points[:, d], minlength=words) for d in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def assigned(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


def fit_codebooks(corpus: DataFrame, part: int = PART, words: int = WORDS, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Codewords: parts x words x dimensions of a part."""
    if not 1 <= words <= 256:
        raise ValueError("a code is one byte: at most 256 codewords")
    rows = corpus.filter("embedding IS NOT NULL").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)
    points = matrix(rows.toArrow())
    if not len(points):
        raise ValueError("no vectors to learn from")
    return np.stack([codewords(x, words, rounds, seed + i) for i, x in enumerate(split(points, part).transpose(1, 0, 2))])


def encode(corpus: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``id``, ``training_data_type`` and ``code``, one byte for each part. Rows without a vector have no code."""
    shared = corpus.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        step = max(1, MATRIX_ENTRIES // books.shape[1])
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(start, step)])
                points = split(matrix(rows), books.shape[2])
                if points.shape[1] != len(books):
                    raise ValueError(f"vectors have {points.shape[1]} parts, the codebooks {len(books)}")
                codes = np.stack([assigned(points[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    rows["id"].combine_chunks(), rows["training_data_type"].combine_chunks(), pa.array([x.tobytes() for x in codes], pa.binary())], names=["id", "training_data_type", "code"])

    rows = corpus.filter("embedding IS NOT NULL").select(F.col("id").cast("string").alias("id"), "training_data_type", "embedding")
    return rows.mapInArrow(run, "id string, training_data_type string, code binary")


def _by_codes(books: np.ndarray, questions: pa.Table, rows: pa.Table, k: int, least: np.ndarray):
    """Squared distances to the codewords of a row, which are looked up and laid end to end; all rows are one scope."""
    asked = split(matrix(questions), books.shape[2])
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(-1, len(books))
    stored = books[np.arange(len(books)), codes]
    return near_pairs("l2sq", asked.reshape(len(asked), -1), stored.reshape(len(codes), -1), k, least)


def _equal_codes(rows: pa.Table) -> np.ndarray:
    return rows["code"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def rescored(k: int, n: int) -> int:
    """How many rows of ``n`` are scored with their vectors for ``k`` that are wanted."""
    return math.ceil(RERANK * k * max(1.0, n / RERANK_OF) ** RERANK_GROWTH)


def pq_knn(questions: DataFrame, coded: DataFrame, corpus: DataFrame, codebooks: np.ndarray, k: int = 10, rerank: int | None = None, **sizes) -> DataFrame:
    """About the ``k`` nearest rows (l2) of every question: question_id, training_data_type, id, distance, rank. ``coded`` holds the
    codes of ``corpus``; distances given out are exact. Without ``rerank``, :func:`rescored` rows are scored with their vectors. With ``rerank`` as large as the corpus all hits are."""
    entries = F.size("embedding")
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "embedding").filter("embedding IS NOT NULL")
    stored = coded.select("id", "training_data_type", F.lit(EACH).alias("scope"), "code")
    hits = block_search(partial(_by_codes, codebooks), asked, stored, rerank or rescored(k, coded.count()), (F.length("code"), entries), **{"same": _equal_codes} | sizes)
    vectors = corpus.select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("stored"))
    pairs = hits.select("question_id", "training_data_type", "id").join(vectors, "id").join(asked, "question_id")
    scored = pairs.select("question_id", "training_data_type", "id", F.round(l2(F.col("embedding"), F.col("stored")), DIGITS).alias("distance"))
    return top_k(scored, ["question_id"], [F.asc("distance"), F.asc("id")], k)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of ``wanted`` hits (question_id, id) that were found."""
    pairs = wanted.select("question_id", "id").join(found.select("question_id", "id", F.lit(1).alias("hit")), ["question_id", "id"], "left")
    hits, n = pairs.agg(F.count("hit"), F.count(F.lit(1))).first()
    return hits / n if n else 1.0
