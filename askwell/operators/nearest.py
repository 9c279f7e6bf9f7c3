"""Exact nearest neighbours over embeddings, with the filters and cut-offs around them."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.operators.blocks import block_search
from askwell.schemas import KINDS

METRICS = ("l2", "l2sq", "cosine", "dot")
DIGITS = 6
RETRIEVAL_THRESHOLD = 1.5   # fixed value: default distance cut, on squared distances
RERANK_THRESHOLD = 0.1      # fixed value: default rerank score cut
EXACT_PAIRS = 8192          # pairs whose distances are worked out together
EACH = "all"                # kind used where hits are ranked over all kinds together


def _stored(table: pa.Table) -> np.ndarray:
    """The vectors as a matrix of their own type."""
    vectors = table["embedding"].combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(vectors) == 0:
        return flat.reshape(0, 0)
    dims = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(dims) != 1 or np.isnan(dims[0]):
        raise ValueError("embeddings differ in length or are null; route them out with dim_check first")
    return flat.reshape(len(vectors), -1)


def matrix(table: pa.Table) -> np.ndarray:
    return _stored(table).astype(np.float64)


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if metric in ("l2", "l2sq"):
        squared = ((a - b) ** 2).sum(axis=1)
        return squared if metric == "l2sq" else np.sqrt(squared)
    inner = (a * b).sum(axis=1)
    if metric == "dot":
        return -inner
    lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.where(lengths > 0, 1.0 - inner / np.where(lengths > 0, lengths, 1.0), 1.0)


def near_pairs(metric: str, asked: np.ndarray, stored: np.ndarray, k: int, least: np.ndarray | None = None):
    """(question, row, distance) of all pairs that may be among a question's ``k`` nearest rows and are no farther than ``least``.

    One matrix product in single precision picks every row within rounding error of the k-th best; if too many are that near, or
    numbers are too large, one in double precision. The distances are exact.
    """
    n, m = len(asked), len(stored)
    if k >= m and least is None:
        q, r = (x.ravel() for x in np.indices((n, m)))
    else:
        with np.errstate(all="ignore"):
            most = float(np.sqrt((asked * asked).sum(axis=1)).max(initial=0) + np.sqrt((stored * stored).sum(axis=1)).max(initial=0))
        single = np.isfinite(most) and most < 1e15
        q, r = _near(metric, asked, stored, k, least, most, np.float32 if single else np.float64)
        if single and len(q) > 16 * (k + 4) * n:
            q, r = _near(metric, asked, stored, k, least, most, np.float64)
    parts = [slice(i, i + EXACT_PAIRS) for i in range(0, len(q), EXACT_PAIRS)]
    return q, r, np.concatenate([_exact(metric, asked[q[i]], stored[r[i]]) for i in parts] or [np.array([])])


def _near(metric: str, asked: np.ndarray, stored: np.ndarray, k: int, least: np.ndarray | None, most: float, kind: type):
    """Question and row of the pairs, by distances short of what is the same for all rows of a question."""
    offset = np.zeros(len(asked))
    if metric == "dot":
        left, right = -asked, stored
    elif metric == "cosine":
        of_length_1 = lambda x, n: x / np.where(n > 0, n, 1.0)
        left, right = (of_length_1(x, np.sqrt((x * x).sum(axis=1, keepdims=True))) for x in (-asked, stored))
        offset, most = offset + 1.0, 2.0
    else:
        left = np.hstack([-2.0 * asked, np.ones((len(asked), 1))])
        right = np.hstack([stored, (stored * stored).sum(axis=1, keepdims=True)])
        offset = (asked * asked).sum(axis=1)
    rough = left.astype(kind) @ right.astype(kind).T
    # what rounding does to a product of the lengths, and to six digits
    error = (asked.shape[1] + 8) * float(np.finfo(kind).eps) * most * most
    slack = 2 * error + 4e-6 * max(1.0, most if metric == "l2" else 1.0)
    if not np.isfinite(slack):
        slack = np.inf
    if least is not None and np.isfinite(least).all():
        cut = (least * least if metric == "l2" else least) - offset + slack
        near = rough <= cut.astype(kind)[:, None]
        if k >= rough.shape[1] or np.count_nonzero(near) <= 8 * (k + 4) * len(asked):
            return _true_places(near)
    else:
        cut = np.full(len(asked), np.inf)
        near = None
    if k < rough.shape[1]:
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64)
        kth = np.where(np.isnan(kth), np.inf, kth)
        near = rough <= np.minimum(cut, kth + slack).astype(kind)[:, None]
    else:
        near = np.ones(rough.shape, dtype=bool)
    return _true_places(near)


def _true_places(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true entries; mostly there are few, so eight are looked at together."""
    flat = near.ravel()
    if len(flat) % 8 or np.count_nonzero(flat) > len(flat) // 64:
        at = np.flatnonzero(flat)
    else:
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        at = at[flat[at]]
    return np.divmod(at, near.shape[1])


def candidates(metric: str, questions: pa.Table, rows: pa.Table, k: int, least: np.ndarray | None = None):
    """The pairs of :func:`near_pairs` with their distances rounded to six digits, which alone decide."""
    asked, stored = matrix(questions), matrix(rows)
    if not (len(asked) and len(stored)):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if stored.shape[1] != asked.shape[1]:
        raise ValueError(f"questions have {asked.shape[1]} dimensions, the corpus has {stored.shape[1]}")
    q, r, distance = near_pairs(metric, asked, stored, k, least)
    return q, r, np.round(distance, DIGITS) + 0.0


def equal_rows(rows: pa.Table) -> np.ndarray:
    """A number for each row; rows with one number have the same vector."""
    vectors = np.ascontiguousarray(_stored(rows))
    if not vectors.size:
        return np.zeros(len(vectors), dtype=np.int64)
    return np.unique(vectors.view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_inverse=True)[1].ravel()


def knn(
    questions: DataFrame, corpus: DataFrame, k: dict | int = 10, metric: str = "l2", *, per_kind: bool = False,
    lists: list[str] | None = None, **sizes,
) -> DataFrame:
    """The ``k`` nearest corpus rows of every question: question_id, training_data_type, id, distance, rank.

    ``per_kind`` (implied by a dict of kind -> k) ranks within each kind, else all kinds rank together.
    Distances are rounded to six digits; ties go to the smaller id. ``l2sq`` is the square of ``l2``; dot
    products count as negative distances. ``lists`` names columns on both sides that must agree (see
    :mod:`askwell.operators.ivf`). Rows and questions without a vector take no part; ``corpus.dim_check`` lists them.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    lists = lists or []
    by_kind = per_kind or isinstance(k, dict)
    scope = F.col("training_data_type") if by_kind else F.lit(EACH)
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "embedding", *lists)
    stored = corpus.select("id", "training_data_type", scope.alias("scope"), "embedding", *lists)
    entries = F.size("embedding")
    return block_search(
        partial(candidates, metric), asked, stored, k, (entries, entries), lists=lists, scopes=len(KINDS) if by_kind else 1,
        **{"same": equal_rows, "needs": ("embedding", "embedding")} | sizes,
    )


def search(
    questions: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2", *, kind: str | None = None,
    prefilter: bool = True, **sizes,
) -> DataFrame:
    """Top-k of one kind. ``prefilter`` searches that kind only; else the kind is picked out of the k
    nearest of all kinds, which may leave fewer."""
    if kind is None:
        return knn(questions, corpus, k, metric, **sizes)
    if prefilter:
        return knn(questions, corpus.filter(F.col("training_data_type") == kind), {kind: k}, metric, **sizes)
    return knn(questions, corpus, k, metric, **sizes).filter(F.col("training_data_type") == kind)


def within(hits: DataFrame, threshold: float = RETRIEVAL_THRESHOLD) -> DataFrame:
    """Hits nearer than ``threshold``."""
    return hits.filter(F.col("distance") < threshold)


def score_passed(
    score: Column, rerank: Column | bool = False, retrieval_threshold: float = RETRIEVAL_THRESHOLD,
    rerank_threshold: float = RERANK_THRESHOLD,
) -> Column:
    """Whether a value is good enough: above the rerank cut, or below the distance cut."""
    flag = F.lit(rerank) if isinstance(rerank, bool) else rerank
    return F.when(flag, score > rerank_threshold).otherwise(score < retrieval_threshold)


def with_content(hits: DataFrame, corpus: DataFrame, *columns: str) -> DataFrame:
    """Corpus columns joined to hits by id; nothing is embedded again. Hits of few questions are marked
    small by the search, so the corpus is scanned where it lies."""
    return hits.join(corpus.select("id", *columns), "id")


def merge_duplicates(hits: DataFrame) -> DataFrame:
    """One row per question and document with the mean score; hits without an id are dropped."""
    return (
        hits.filter(F.col("id").isNotNull()).groupBy("question_id", "id")
        .agg(F.avg("score").alias("score"), F.max("content").alias("content"))
    )


def renumber(hits: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Places from 1 within ``keys``; for hits, which are at most k per key."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
