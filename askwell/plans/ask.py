"""Asking: from a table of questions to SQL, results and new training data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.operators.context import MAX_TOKENS, build_prompts
from askwell.operators.embedding import ModelFactory as Embedder
from askwell.operators.embedding import embed
from askwell.operators.model import ModelFactory, extracted, suggest_columns, two_step
from askwell.operators.retrieval import N_RESULTS, SUGGESTION_RESULTS, multi_query, retrieve_context
from askwell.operators.run import auto_train, previews, run_results, run_statements
from askwell.operators.training import learn
from askwell.session import shared_folder
from askwell.sources.store import CorpusStore


def suggested_context(
    questions: DataFrame, corpus: DataFrame, model: ModelFactory, embedder: Embedder | None = None, *,
    k: int = N_RESULTS, per_column: int = SUGGESTION_RESULTS, **options,
) -> DataFrame:
    """Context whose DDL is searched by the columns a model suggests, each chunk labelled with where it was
    found; pairs and documentation are searched by the question. Suggestions are written once."""
    spark = corpus.sparkSession
    path = shared_folder(spark, "suggestions")
    embed(suggest_columns(questions, model), "hint", embedder, task="question").write.parquet(path)
    chunks = multi_query(
        spark.read.parquet(path), corpus.filter("training_data_type = 'ddl'"), per_column, **options
    )
    item = F.struct("i", "j", "id", "chunk")
    ddl = chunks.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("found")).select(
        "question_id",
        F.transform("found", lambda x: F.struct(
            x["id"].alias("id"), F.lit(None).cast("string").alias("question"), x["chunk"].alias("content")
        )).alias("by_column"),
    )
    others = retrieve_context(questions, corpus.filter("training_data_type <> 'ddl'"), {"sql": k, "documentation": k})
    # the search by question finds no DDL, so its list is empty
    return others.join(ddl, "question_id", "left").withColumn("ddl", F.coalesce("by_column", "ddl")).drop("by_column")


def generate_sql(
    questions: DataFrame, corpus: DataFrame, model: ModelFactory, *, k=N_RESULTS, max_tokens: int = MAX_TOKENS,
    mode: str = "full", extract: str = "last", allow_data: bool = False, context: DataFrame | None = None, calls: dict | None = None,
    preview_rows: int | None = None, **sizes,
) -> DataFrame:
    """SQL for every question (question_id, question, embedding): question_id, question, response, error,
    sql, is_valid. The context is searched by the question unless given. ``calls``: options of the model calls, see
    :func:`askwell.operators.model.generate_responses`. ``preview_rows``: rows of a look into the data that the model is shown, all without
    it, as far as half of ``max_tokens`` goes."""
    spark = corpus.sparkSession
    if context is None:
        context = retrieve_context(questions, corpus, k, **sizes)
    rebuild = lambda c: build_prompts(c, mode, max_tokens=max_tokens)
    responses = two_step(context, model, rebuild, lambda s: previews(spark, s, preview_rows, max_tokens // 2), allow_data=allow_data, **(calls or {}))
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    return asked.join(extracted(responses, extract), "question_id")


def ask_batch(
    spark: SparkSession, questions: DataFrame, corpus: DataFrame, model: ModelFactory, *, store: CorpusStore | None = None,
    folder: str | None = None, embedder: Embedder | None = None, **options,
) -> DataFrame:
    """Questions answered on Spark's catalog: one outcome row per question, results as Parquet.

    Model responses are kept in ``folder`` as they come: a run that was killed goes on where it was if it is given the same folder. With ``store``
    the pairs that gave rows are added to it, embedded by ``embedder`` if it keeps vectors: the next ``store.read()``
    finds them without another pass through the model.
    """
    folder = folder or shared_folder(spark, "ask")
    calls = {"answers": f"{folder}/answers"} | (options.pop("calls", None) or {})
    path = f"{shared_folder(spark, 'ask')}/extracted"
    generate_sql(questions, corpus, model, calls=calls, **options).write.parquet(path)
    found = spark.read.parquet(path)
    runs = run_results(found, run_statements(spark, found, f"{folder}/runs-{uuid.uuid4().hex}"))
    if store is not None:
        learn(store, auto_train(runs), embedder)
    return runs
