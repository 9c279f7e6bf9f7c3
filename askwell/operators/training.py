"""Training: requests routed, questions made where they lack, rows embedded and stored, ready to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.operators.corpus import add_ddl, add_documentation, add_pairs, route_training
from askwell.operators.embedding import ModelFactory, embed
from askwell.operators.model import ModelFactory as PromptModel
from askwell.operators.model import questions_for_sql
from askwell.session import shared_folder
from askwell.sources.store import CorpusStore


def training_rows(requests: DataFrame, questions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Corpus rows of training requests (question, sql, ddl, documentation), and the requests that add nothing.

    ``questions`` (sql, question) has the questions a model made for bare statements; a statement without one is a reject.
    """
    routed = route_training(requests)
    pairs = routed.filter("route = 'sql'")
    if questions is not None:
        made = questions.groupBy("sql").agg(F.min("question").alias("_made"))
        pairs = pairs.join(made, "sql", "left").withColumn("question", F.coalesce(F.when(~F.col("needs_question"), F.col("question")), "_made")).drop("_made")
    asked = F.coalesce(F.length("question"), F.lit(0)) > 0
    rows = (
        add_pairs(pairs.filter(asked)).unionByName(add_ddl(routed.filter("route = 'ddl'")))
        .unionByName(add_documentation(routed.filter("route = 'documentation'")))
    )
    lost = routed.filter("route IN ('reject', 'plan')").select("question", "sql", "error")
    return rows, lost.unionByName(pairs.filter(~asked).select("question", "sql", F.lit("no question for this sql").alias("error")))


def made_questions(requests: DataFrame, asker: PromptModel, **calls) -> DataFrame:
    """Questions (sql, question, error) that a model makes for the bare statements of training requests, each distinct one once."""
    bare = route_training(requests).filter("route = 'sql' AND needs_question").select("sql").distinct()
    return questions_for_sql(bare, asker, key="sql", **calls)


def train(
    store: CorpusStore, requests: DataFrame, embedder: ModelFactory | None = None, questions: DataFrame | None = None,
    asker: PromptModel | None = None, **calls,
) -> DataFrame:
    """Adds what is new of the requests to ``store``, with vectors; gives back the rejects. Questions for bare statements are given,
    or made by the model ``asker`` and written before they are used (``calls``: see :func:`askwell.operators.model.generate_responses`)."""
    if asker is not None and questions is None:
        path = shared_folder(store.spark, "made-questions")
        made_questions(requests, asker, **calls).filter("question IS NOT NULL").select("sql", "question").write.parquet(path)
        questions = store.spark.read.parquet(path)
    rows, rejects = training_rows(requests, questions)
    learn(store, rows, embedder)
    return rejects


def learn(store: CorpusStore, rows: DataFrame, embedder: ModelFactory | None = None) -> None:
    """Adds corpus rows that are not stored yet, with the vectors of their texts if the store keeps vectors."""
    if "embedding" in store.schema.names and "embedding" not in rows.columns:
        rows = embed(rows, "embed_text", embedder)
    store.append_new(rows)
