"""The layout in the plane: neighbourhoods, copies, rows without a vector, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwell.operators import layout
from askwell.operators.embedding import projection_2d

SCHEMA = "id string, role string, embedding array<double>"


def rows(spark, points):
    return spark.createDataFrame([(f"r{i:04d}", "corpus", p.tolist()) for i, p in enumerate(points)], SCHEMA).repartition(4)


def plain_trust(points, places, k):
    apart = lambda x: ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(len(x), np.inf))
    order = np.argsort(apart(points), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(1, len(points) + 1)[None], axis=1)
    near = np.argsort(apart(places), axis=1, kind="stable")[:, :k]
    n = len(points)
    return 1 - 2 * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum() / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def rings():
    """Ten groups on circles in twenty dimensions, which no plane of components keeps apart."""
    rng = np.random.default_rng(2)
    turn = rng.uniform(0, 2 * np.pi, 400)
    group = np.arange(400) % 10
    points = rng.normal(scale=0.05, size=(400, 20))
    points[np.arange(400), 2 * group] += np.cos(turn)
    points[np.arange(400), 2 * group + 1] += np.sin(turn)
    return points


def test_neighbours_stay_together(spark, rings):
    df = rows(spark, rings)
    for landmarks in (2000, 150):  # all rows, and most rows placed by others
        placed = layout.layout_2d(df, landmarks=landmarks, epochs=150)
        got = {r["id"]: (r["x"], r["y"]) for r in placed.collect()}
        places = np.array([got[f"r{i:04d}"] for i in range(400)])
        trust = layout.trustworthiness(df, placed, k=5, asked=400)
        assert trust == pytest.approx(plain_trust(rings, places, 5), abs=1e-4)  # search rounds distances
        assert trust > layout.trustworthiness(df, projection_2d(df), k=5, asked=400) + 0.05


def test_copies_have_one_place_and_nulls_none(spark):
    points = np.random.default_rng(1).normal(size=(60, 4))
    points[:25] = points[0]
    df = rows(spark, points).unionByName(spark.createDataFrame([("none", "corpus", None)], SCHEMA)).withColumn("x", F.lit(1)).drop("x")
    got = layout.layout_2d(df, landmarks=20, epochs=30).collect()
    assert len(got) == 60 and len({(r["x"], r["y"]) for r in got if r["id"] < "r0025"}) == 1
    assert np.isfinite([[r["x"], r["y"]] for r in got]).all()
    again = layout.layout_2d(df.repartition(2), landmarks=20, epochs=30).collect()
    assert {r["id"]: r["x"] for r in again} == pytest.approx({r["id"]: r["x"] for r in got})


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(str(i), "corpus", [float(i), 1.0]) for i in range(n)], SCHEMA)
    got = layout.layout_2d(df).collect()
    assert len(got) == n and all(np.isfinite([r["x"], r["y"]]).all() for r in got)
