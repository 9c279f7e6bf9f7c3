"""Retrieval built on search: reranking, several queries per question, combined context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import words
from askwell.operators.nearest import (
    RERANK_THRESHOLD,
    RETRIEVAL_THRESHOLD,
    knn,
    renumber,
    score_passed,
    with_content,
    within,
)

THRESHOLD_METRIC = "l2sq"  # fixed value: what the default distance cut is meant for
OVERFETCH = 3       # fixed value: candidates per wanted row when reranking
WIDE_FETCH = 50     # fixed value: candidates of the wide rerank
N_RESULTS = 10      # fixed value
SUGGESTION_RESULTS = 5  # fixed value: rows per suggested column


def overlap(question: Column, content: Column) -> Column:
    """Shared words over all words of both texts."""
    a, b = F.array_distinct(words(question)), F.array_distinct(words(content))
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def model_scorer(factory: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A pair scorer out of a user model, loaded once per Python worker."""
    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = factory()
        for questions, contents in pairs:
            yield pd.Series(run(list(questions), list(contents)), index=questions.index, dtype="float64")

    return score


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The ``k`` best hits per question by score of question and content; equal scores stay in search order."""
    scored = hits.withColumn("score", F.round(scorer(F.col("question"), F.col("content")), 6))
    numbered = renumber(scored, ["question_id"], [F.desc("score"), F.asc("rank")], "place")
    return numbered.filter(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def search_with_score(
    questions: DataFrame, corpus: DataFrame, k: int = N_RESULTS, *, reranked: bool = False, overfetch: int = OVERFETCH,
    threshold: float | None = RETRIEVAL_THRESHOLD, scorer=overlap, metric: str = THRESHOLD_METRIC, **sizes,
) -> DataFrame:
    """Hits with their content, nearer than ``threshold``. With ``reranked`` more are fetched, cut by distance, scored and cut to ``k``."""
    hits = knn(questions, corpus, k * (overfetch if reranked else 1), metric, **sizes)
    if threshold is not None:
        hits = within(hits, threshold)
    hits = with_content(hits, corpus, "content")
    if not reranked:
        return renumber(hits.drop("rank"), ["question_id"], [F.asc("distance"), F.asc("id")])
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    return rerank(hits.join(asked, "question_id"), k, scorer)


def rerank_wide(questions: DataFrame, corpus: DataFrame, k: int = N_RESULTS, scorer=overlap, **sizes) -> DataFrame:
    """Fifty candidates whatever their distance, scored and cut to ``k``."""
    hits = with_content(knn(questions, corpus, WIDE_FETCH, THRESHOLD_METRIC, **sizes), corpus, "content")
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    return rerank(hits.join(asked, "question_id"), k, scorer)


def suggestions(responses: DataFrame) -> DataFrame:
    """A model's column suggestions, one per line: question_id, i, hint, suggestion_id."""
    lines = responses.select("question_id", F.posexplode(F.split("response", "\n")).alias("i", "hint"))
    return lines.withColumn("suggestion_id", F.concat_ws("#", "question_id", "i"))


def multi_query(
    hints: DataFrame, corpus: DataFrame, k: int = SUGGESTION_RESULTS, *, reranked: bool = False,
    retrieval_threshold: float = RETRIEVAL_THRESHOLD, rerank_threshold: float = RERANK_THRESHOLD, scorer=overlap, **sizes,
) -> DataFrame:
    """Search per suggestion (question_id, i, hint, suggestion_id, embedding), each chunk kept where first
    seen and labelled with the places of suggestion and hit."""
    asked = hints.select(F.col("suggestion_id").alias("question_id"), F.col("hint").alias("question"), "embedding")
    hits = search_with_score(
        asked, corpus, k, reranked=reranked, threshold=retrieval_threshold, scorer=scorer, **sizes
    )
    value = F.col("score") if reranked else F.col("distance")
    passed = hits.filter(score_passed(value, reranked, retrieval_threshold, rerank_threshold)).select(
        F.col("question_id").alias("suggestion_id"), "id", "content", (F.col("rank") - 1).alias("j"),
        value.alias("score"),
    )
    joined = passed.join(hints.select("suggestion_id", "question_id", "i"), "suggestion_id")
    first = joined.groupBy("question_id", "content").agg(F.min_by(F.struct("i", "j", "id", "score"), F.struct("i", "j")).alias("f"))
    return first.select(
        "question_id", "f.i", "f.j", "f.id", "f.score",
        F.concat_ws(".", F.col("f.i"), F.col("f.j"), F.col("content")).alias("chunk"),
    )


def retrieve_context(questions: DataFrame, corpus: DataFrame, k: dict[str, int] | int = N_RESULTS, **sizes) -> DataFrame:
    """For every question its nearest pairs, DDL and documentation, each kind an array in rank order."""
    per_kind = k if isinstance(k, dict) else {kind: k for kind in ("sql", "ddl", "documentation")}
    hits = with_content(knn(questions, corpus, per_kind, **sizes), corpus, "question", "content")
    item = F.struct("rank", "id", "question", "content")

    def of(kind: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("training_data_type") == kind, item)))
        return F.transform(found, lambda x: F.struct(x["id"].alias("id"), x["question"].alias("question"), x["content"].alias("content")))

    found = hits.groupBy("question_id").agg(
        of("sql").alias("pairs"), of("ddl").alias("ddl"), of("documentation").alias("documentation")
    )
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    empty = lambda c: F.coalesce(F.col(c), F.expr("cast(array() as array<struct<id:string,question:string,content:string>>)"))
    return asked.join(found, "question_id", "left").select(
        "question_id", "question", *[empty(c).alias(c) for c in ("pairs", "ddl", "documentation")]
    )


def starter_questions(corpus: DataFrame, empty_embedding: list[float], k: int = N_RESULTS, **sizes) -> DataFrame:
    """The stored questions nearest to an empty question."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([("", empty_embedding)], "question_id string, embedding array<double>")
    hits = knn(asked, corpus.filter("training_data_type = 'sql'"), {"sql": k}, **sizes)
    return with_content(hits, corpus, "question").select("rank", "id", "question")


def hit_vectors(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """The vectors of what was found, taken from the corpus."""
    return with_content(hits, corpus, "embedding").select("question_id", "rank", "id", "embedding")
