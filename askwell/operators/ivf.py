"""Approximate search: rows are put in the list of their nearest centre, questions look into a few lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.operators.blocks import MATRIX_ENTRIES, MAX_BROADCAST
from askwell.operators.nearest import candidates, knn
from askwell.operators.ranking import bounded_rows
from askwell.schemas import KINDS


MOST_PROBED = 1000


def fit_centres(corpus: DataFrame, n_lists: int, seed: int = 7, iterations: int = 10) -> DataFrame:
    """K-means centres of the vectors: id, embedding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = corpus.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=n_lists, seed=seed, maxIter=iterations).fit(features)
    rows = [(str(i), [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(rows, "id string, embedding array<double>")


def nearest_lists(rows: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``lists``, the ids of the ``n`` nearest centres (ties by id).

    Up to ``MAX_BROADCAST`` centres go to every task; the rows are scanned once and not shuffled. More centres are searched
    like any corpus; rows are told apart by ``question_id`` or ``id`` then. Both ways give the same lists.
    """
    table = bounded_rows(centres.select("id", "embedding").orderBy("id"), MAX_BROADCAST)
    if table is None:
        return _searched_lists(rows, centres, n)
    # in order of their ids, so that the smaller index wins a tie
    centre_table = table.append_column("scope", pa.array([""] * table.num_rows))
    shared = rows.sparkSession.sparkContext.broadcast(centre_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        names = np.array(points["id"].to_pylist(), dtype=object)
        step = max(1, MATRIX_ENTRIES // max(1, len(names)))
        for batch in batches:
            picks: list = []
            for start in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(start, step)])
                row, centre, distance = candidates("l2", part, points, n)
                order = np.lexsort((centre, distance, row))
                row, centre = row[order], centre[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                picks.extend(names[centre[place < n]].reshape(part.num_rows, -1).tolist())
            lists = pa.array(picks, type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, schema)


def _searched_lists(rows: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    key = "question_id" if "question_id" in rows.columns else "id"
    asked = rows.select(F.col(key).alias("question_id"), "embedding").dropDuplicates(["question_id"])
    found = knn(asked, centres.withColumn("training_data_type", F.lit(KINDS[0])), n)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    lists = found.groupBy("question_id").agg(ordered.alias("lists")).withColumnRenamed("question_id", "_key")
    return rows.join(lists, rows[key].cast("string") == lists["_key"]).select(*rows.columns, "lists")


def build_lists(corpus: DataFrame, centres: DataFrame) -> DataFrame:
    """The corpus with the list of its nearest centre; written with ``partitionBy("list_id")`` it is the index."""
    return nearest_lists(corpus, centres, 1).withColumn("list_id", F.col("lists")[0]).drop("lists")


def ivf_knn(
    questions: DataFrame, indexed: DataFrame, centres: DataFrame, k: int = 10, n_probe: int = 3, metric: str = "l2", **sizes
) -> DataFrame:
    """The ``k`` nearest rows found in each question's ``n_probe`` nearest lists. With all lists probed the
    result is exact. Hot lists are cut into cells of bounded size. If few lists are probed, only their partitions of a
    stored index are read."""
    asked = nearest_lists(questions.select("question_id", "embedding"), centres, n_probe)
    probes = asked.withColumn("list_id", F.explode("lists")).drop("lists")
    probed = bounded_rows(probes.select("list_id").distinct(), MOST_PROBED)
    if probed is not None:
        indexed = indexed.filter(F.col("list_id").isin(probed["list_id"].to_pylist()))
    return knn(probes, indexed, k, metric, lists=["list_id"], **sizes)
