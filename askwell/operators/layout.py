"""Vectors as points in the plane that keep neighbourhoods: a neighbour graph of landmarks, laid out by attraction along its
edges and repulsion from sampled points; every other row is placed by its nearest landmarks.

The landmarks are a bounded sample (``landmarks`` rows with the smallest hashes of their ids); their layout is fitted on the
driver. All rows are then placed in one scan without a shuffle, as the landmarks go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.functions.vectors import l2
from askwell.operators.blocks import MATRIX_ENTRIES
from askwell.operators.nearest import knn, matrix
from askwell.operators.ranking import top_k

LANDMARKS, NEIGHBOURS, EPOCHS = 2000, 15, 300
#: Similarity in the plane is 1 / (1 + A * distance ** (2 * B)): the curve that falls from 1 at a distance of 0.1.
A, B = 1.577, 0.895
REPULSIONS, CLIP = 5, 4.0
PLACED_BY = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def fuzzy_graph(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of each point's ``k`` nearest ones, with weights: 1 up to the nearest one's distance, then falling so that a point's
    weights sum to log2(k), whatever the density around it; an edge seen from either end counts."""
    n = len(points)
    k = min(k, n - 1)
    apart = distances(points, points)
    np.fill_diagonal(apart, np.inf)
    nearest = np.argpartition(apart, k - 1, axis=1)[:, :k]
    far = np.take_along_axis(apart, nearest, axis=1)
    beyond = far - far.min(axis=1, keepdims=True)
    low, high = np.zeros(n), np.full(n, 1e4 * max(float(beyond.max(initial=0.0)), 1e-9))
    for _ in range(64):  # the scale at which the weights have their sum, by halving
        middle = (low + high) / 2
        large = np.exp(-beyond / np.maximum(middle, 1e-12)[:, None]).sum(axis=1) > np.log2(max(k, 2))
        low, high = np.where(large, low, middle), np.where(large, middle, high)
    weights = np.exp(-beyond / np.maximum((low + high) / 2, 1e-12)[:, None])
    dense = np.zeros((n, n), dtype=np.float32)
    np.put_along_axis(dense, nearest, weights.astype(np.float32), axis=1)
    both = dense + dense.T - dense * dense.T
    start, end = np.nonzero(both)
    return start, end, both[start, end].astype(np.float64)


def principal(points: np.ndarray) -> np.ndarray:
    """First two principal components."""
    centred = points - points.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    flat = centred @ axes[:2].T
    return np.pad(flat, ((0, 0), (0, 2 - flat.shape[1])))


def laid_out(points: np.ndarray, k: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Places in the plane, by steps along sampled edges and away from sampled points."""
    n, rng = len(points), np.random.default_rng(seed)
    if n < 3:
        return principal(points) if n else np.zeros((0, 2))
    start, end, weight = fuzzy_graph(points, k)
    at = principal(points)
    at = at / max(float(np.abs(at).max()), 1e-9) * 10 + rng.normal(scale=1e-4, size=at.shape)
    chance = weight / weight.max()
    for epoch in range(epochs):
        step = 1.0 - epoch / epochs
        used = rng.random(len(chance)) < chance
        i, j = start[used], end[used]
        gap = at[i] - at[j]
        d2 = (gap * gap).sum(axis=1)
        pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * np.maximum(d2, 1e-12) ** B), 0.0)
        moves = np.clip(pull[:, None] * gap, -CLIP, CLIP) * step
        change = np.zeros_like(at)
        np.add.at(change, i, moves)
        i, j = np.repeat(i, REPULSIONS), rng.integers(0, n, len(i) * REPULSIONS)
        gap = at[i] - at[j]
        d2 = (gap * gap).sum(axis=1)
        push = 2 * B / ((0.001 + d2) * (1 + A * np.maximum(d2, 1e-12) ** B))
        np.add.at(change, i, np.where((i != j)[:, None], np.clip(push[:, None] * gap, -CLIP, CLIP) * step, 0.0))
        at = at + np.clip(change, -CLIP, CLIP)
    return at


def layout_2d(rows: DataFrame, landmarks: int = LANDMARKS, k: int = NEIGHBOURS, epochs: int = EPOCHS) -> DataFrame:
    """``rows`` (id, embedding, and others) with ``x`` and ``y`` in place of ``embedding``. Equal vectors have one place. Rows without
    a vector take no part; vectors of one length are asked for."""
    rows = rows.filter("embedding IS NOT NULL")
    chosen = rows.select("id", "embedding").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(landmarks)
    points = matrix(chosen.toArrow())
    points = np.unique(points, axis=0) if len(points) else points
    shared = rows.sparkSession.sparkContext.broadcast((points, laid_out(points, k, epochs)))
    kept = [f for f in rows.schema.fields if f.name != "embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        step = max(1, MATRIX_ENTRIES // max(1, len(known)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                apart = distances(matrix(pa.Table.from_batches([part])), known)
                n = min(PLACED_BY, apart.shape[1])
                nearest = np.argpartition(apart, n - 1, axis=1)[:, :n]
                far = np.take_along_axis(apart, nearest, axis=1)
                first = far.min(axis=1, keepdims=True)
                scale = np.maximum((far - first).mean(axis=1, keepdims=True), 1e-12)
                weight = np.where(first <= 1e-6, far == first, np.exp(-(far - first) / scale))
                xy = (places[nearest] * weight[:, :, None]).sum(axis=1) / weight.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=[*(f.name for f in kept), "x", "y"])

    return rows.mapInArrow(place, T.StructType([*kept, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def trustworthiness(rows: DataFrame, placed: DataFrame, k: int = 12, asked: int = 200) -> float:
    """How far neighbours in the plane are neighbours among the vectors, 1 at best: for ``asked`` rows, a fixed sample by the hash of
    their ids, the ``k`` nearest places of all rows are looked up, and counted by how much farther than k-th they are
    among all vectors. ``rows``: id, embedding; ``placed``: id, x, y; ids are unique."""
    n = rows.count()
    if n <= 2 * k:
        raise ValueError(f"{n} rows are too few for neighbourhoods of {k}")
    sample = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(asked)
    flat = placed.select("id", F.lit("sql").alias("training_data_type"), F.array("x", "y").alias("embedding"))
    near = knn(flat.join(F.broadcast(sample.select("id")), "id").select(F.col("id").alias("question_id"), "embedding"), flat, k + 1)
    others = near.filter(F.col("question_id") != F.col("id")).drop("rank")
    near = top_k(others, ["question_id"], [F.asc("distance"), F.asc("id")], k)  # without the row itself
    pairs = near.join(rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("v")), "id")
    pairs = pairs.join(F.broadcast(sample.select(F.col("id").cast("string").alias("question_id"), F.col("embedding").alias("q"))), "question_id")
    table = pairs.select("question_id", "q", l2("q", "v").alias("d"), "rank").orderBy("question_id", "rank").toArrow()  # asked x (k + 1) rows at most
    vectors = matrix(table.select(["q"]).rename_columns(["embedding"]))
    shared = rows.sparkSession.sparkContext.broadcast((vectors, table["d"].to_numpy()))

    def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, limits = shared.value
        total = np.zeros(len(limits), dtype=np.int64)
        step = max(1, MATRIX_ENTRIES // max(1, len(limits)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                total += (distances(questions, matrix(pa.Table.from_batches([batch.slice(start, step)]))) < limits[:, None] - 1e-6).sum(axis=1)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.arange(len(total))), "n": pa.array(total)})

    ranks = rows.select("embedding").mapInArrow(closer, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("rank"))  # itself counts as closer
    excess = ranks.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0] or 0
    return 1.0 - 2.0 * excess / (min(asked, n) * k * (2 * n - 3 * k - 1))
