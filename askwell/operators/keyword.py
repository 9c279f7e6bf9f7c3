"""Keyword match over texts: OR of the question's words, ranked by BM25."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import words
from askwell.operators.blocks import block_search
from askwell.operators.ranking import spread
from askwell.session import shared_folder

K1 = 1.2   # fixed value
B = 0.75   # fixed value
DIGITS = 6
POSTING_ENTRIES = 2_000_000  # (row, question) contributions held at once


def _tokens(text_col: str):
    """The words of a text; a null text has none."""
    return F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("tokens")


def term_statistics(corpus: DataFrame, text_col: str = "content") -> DataFrame:
    """The corpus' dictionary, from one pass over the texts: term, texts with it, words.

    The row of the empty term holds the totals: number of texts and of words. Counts combine on the map
    side, so a word found in a third of the texts costs one row per task.
    """
    tokens = corpus.select(_tokens(text_col))
    exploded = tokens.select(
        F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("term"),
        F.size("tokens").alias("n"),
    )
    return exploded.groupBy("term").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.when(F.col("term") == "", F.col("n")).otherwise(0)).alias("words"),
    )


def term_weights(questions: DataFrame, statistics: DataFrame, question_col: str):
    """Per question its distinct words with their weights, and the corpus' mean length in words."""
    totals = statistics.filter(F.col("term") == "").first()
    count, mean = (totals["texts"], totals["words"] / totals["texts"]) if totals else (0, 1.0)
    asked = questions.select(
        F.col("question_id").cast("string").alias("question_id"),
        F.explode(F.array_distinct(words(F.col(question_col)))).alias("term"),
    )
    known = statistics.select("term", F.col("texts").cast("double").alias("d"))
    weight = F.log(1.0 + (F.lit(float(count)) - F.col("d") + 0.5) / (F.col("d") + 0.5))
    weighted = (
        asked.join(known, "term").groupBy("question_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
        .select("question_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    )
    return weighted, float(mean) or 1.0


def _score(mean_words: float, questions: pa.Table, rows: pa.Table, k: int, least: np.ndarray):
    """BM25 of a batch of texts for a block of questions, from the words both have; all texts are one scope."""
    lists = questions["terms"].combine_chunks()
    flat = lists.flatten()
    vocabulary = pc.unique(flat)
    term_of = pc.index_in(flat, vocabulary).to_numpy(zero_copy_only=False)
    weight_of = questions["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    asker_of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    by_term = np.argsort(term_of, kind="stable")
    asker_of, weight_of = asker_of[by_term], weight_of[by_term]
    starts = np.searchsorted(term_of[by_term], np.arange(len(vocabulary) + 1))

    texts = rows["tokens"].combine_chunks()
    lengths = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(texts.flatten(), vocabulary).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(texts)), lengths)
    known = ~np.isnan(found.astype(np.float64))
    key = row_of[known] * max(1, len(vocabulary)) + found[known].astype(np.int64)
    posting, count = np.unique(key, return_counts=True)
    row, term = np.divmod(posting, max(1, len(vocabulary)))
    saturation = count * (K1 + 1.0) / (count + K1 * ((1.0 - B) + B * lengths[row] / mean_words))

    n_rows, n_questions = len(texts), len(lists)
    fan_out = starts[term + 1] - starts[term]
    total = np.zeros(n_rows * n_questions)
    ends = np.cumsum(fan_out)
    start = 0
    while start < len(term):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + POSTING_ENTRIES, side="right")))
        fan = fan_out[start:stop]
        which = np.repeat(np.arange(start, stop), fan)
        within = np.arange(len(which)) - np.repeat(np.cumsum(fan) - fan, fan)
        entry = starts[term[which]] + within
        total += np.bincount(
            row[which] * n_questions + asker_of[entry], weights=weight_of[entry] * saturation[which],
            minlength=len(total),
        )
        start = stop
    # texts without a shared word are no hits, however few others there are
    distance = np.where(total > 0, -np.round(total, DIGITS), np.inf).reshape(n_rows, n_questions)
    near = np.isfinite(distance) & (distance <= least)
    if k < n_rows:
        near &= distance <= np.partition(distance, k - 1, axis=0)[k - 1]
    r, q = np.nonzero(near)
    return q, r, distance[r, q]


def bm25(
    questions: DataFrame, corpus: DataFrame, k: int = 10, *, question_col: str = "question",
    text_col: str = "content", statistics: DataFrame | None = None, **sizes,
) -> DataFrame:
    """The ``k`` best texts of every question that share a word with it: question_id,
    training_data_type, id, score, rank. Scores have six digits; ties go to the smaller id.

    ``statistics`` is the corpus' :func:`term_statistics`; without it they are computed once and written
    to the shared folder."""
    corpus = spread(corpus.select("id", "training_data_type", text_col))
    if statistics is None:
        path = shared_folder(corpus.sparkSession, "term-statistics")
        term_statistics(corpus, text_col).write.parquet(path)
        statistics = corpus.sparkSession.read.parquet(path)
    weighted, mean = term_weights(questions, statistics, question_col)
    texts = corpus.select("id", "training_data_type", F.lit("all").alias("scope"), _tokens(text_col))
    hits = block_search(partial(_score, mean), weighted, texts, k, (F.size("tokens"), F.size("terms")), **sizes)
    return hits.select("question_id", "training_data_type", "id", (-F.col("distance")).alias("score"), "rank")
