"""Search against brute force, hot lists and copies included."""

import os
import tracemalloc
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askwell.operators import blocks, ivf, nearest, retrieval
from askwell.operators.embedding import embed, hashed_grams
from askwell.operators.keyword import bm25, term_statistics

RNG = np.random.default_rng(5)
DIM = 8
# a third of the corpus are copies of one vector, and half of it is one kind
POINTS = RNG.normal(size=(300, DIM)).astype(np.float32)
POINTS[:100] = POINTS[0]
ASKED = RNG.normal(size=(40, DIM))
ASKED[0] = POINTS[0]
KINDS = ["sql" if i % 2 else ("ddl" if i % 4 else "documentation") for i in range(300)]


@pytest.fixture(scope="module")
def tables(spark):
    corpus = pd.DataFrame({"id": [f"r{i:03d}" for i in range(300)], "training_data_type": KINDS, "embedding": [list(map(float, p)) for p in POINTS]})
    asked = pd.DataFrame({"question_id": [f"q{i:02d}" for i in range(40)], "embedding": [list(map(float, a)) for a in ASKED]})
    return (
        spark.createDataFrame(asked, "question_id string, embedding array<double>").repartition(3),
        spark.createDataFrame(corpus, "id string, training_data_type string, embedding array<double>").repartition(5),
    )


def distance(metric, a, b):
    if metric in ("l2", "l2sq"):
        return ((a - b) ** 2).sum() ** (0.5 if metric == "l2" else 1)
    if metric == "dot":
        return -(a @ b)
    return 1 - (a @ b) / np.sqrt((a @ a) * (b @ b))


def brute(metric, k, scope=lambda kind: "all", keep=lambda i: True):
    rows = []
    for q, a in enumerate(ASKED):
        best = {}
        for i, p in enumerate(POINTS.astype(float)):
            if keep(i):
                best.setdefault(scope(KINDS[i]), []).append((round(distance(metric, a, p), 6) + 0.0, f"r{i:03d}"))
        for name, found in best.items():
            limit = k[name] if isinstance(k, dict) else k
            rows += [(f"q{q:02d}", i, d, n + 1) for n, (d, i) in enumerate(sorted(found)[:limit])]
    return sorted(rows)


def got(hits):
    return sorted((r["question_id"], r["id"], r["distance"], r["rank"]) for r in hits.collect())


CELLS = {"max_broadcast": 0, "cell_weight": 25 * DIM}


@pytest.mark.parametrize("metric", nearest.METRICS)
@pytest.mark.parametrize("sizes", [{}, CELLS], ids=["scan", "cells"])
def test_exact(tables, metric, sizes):
    assert got(nearest.knn(*tables, 7, metric, **sizes)) == brute(metric, 7)


@pytest.mark.parametrize("sizes", [{}, CELLS], ids=["scan", "cells"])
def test_per_kind(tables, sizes):
    k = {"sql": 4, "ddl": 2, "documentation": 0}
    assert got(nearest.knn(*tables, k, **sizes)) == brute("l2", k, lambda kind: kind)


def test_more_wanted_than_there_is(tables):
    assert len(got(nearest.knn(*tables, 1000))) == 40 * 300


@pytest.mark.parametrize("sizes", [{}, {"max_broadcast": -1}], ids=["scan", "cells"])
def test_nothing_to_ask_or_to_find(tables, sizes):
    asked, corpus = tables
    texts = corpus.withColumn("content", F.col("id"))
    questions = asked.withColumn("question", F.col("question_id"))
    for some, stored in ((questions.limit(0), texts), (questions, texts.limit(0))):
        assert nearest.knn(some, stored, 3, **sizes).count() == 0
        assert bm25(some, stored, 3, **sizes).count() == 0


def test_filters(tables):
    assert got(nearest.search(*tables, 3, kind="ddl")) == brute("l2", 3, keep=lambda i: KINDS[i] == "ddl")
    after = [r for r in brute("l2", 5) if KINDS[int(r[1][1:])] == "ddl"]
    assert got(nearest.search(*tables, 5, kind="ddl", prefilter=False)) == after
    assert all(r[2] < 1.5 for r in got(nearest.within(nearest.knn(*tables, 9))))


def test_vectors_of_other_length_are_refused(tables, spark):
    with pytest.raises(Exception, match="dimensions"):
        nearest.knn(spark.createDataFrame([("q", [1.0])], "question_id string, embedding array<double>"), tables[1]).collect()


def test_lists_probed_fully_are_exact_and_partly_nearly(tables):
    asked, corpus = tables
    centres = ivf.fit_centres(corpus, 6)
    indexed = ivf.build_lists(corpus, centres)
    assert got(ivf.ivf_knn(asked, indexed, centres, 5, n_probe=6, cell_weight=30 * DIM)) == brute("l2", 5)
    found = {r[:2] for r in got(ivf.ivf_knn(asked, indexed, centres, 10, n_probe=4))}
    wanted = {r[:2] for r in brute("l2", 10)}
    assert len(found & wanted) / len(wanted) >= 0.9


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_tiles_hold_few_hits_of_a_question(monkeypatch, metric):
    """Questions and rows come in tiles, and a tile knows how near a row has to be after the ones before."""
    monkeypatch.setattr(blocks, "MATRIX_ENTRIES", 8000)
    monkeypatch.setattr(blocks, "QUESTIONS_HELD", 100)
    rng = np.random.default_rng(8)
    asked, stored = rng.normal(size=(450, DIM)), rng.normal(size=(900, DIM))
    stored[300:500] = stored[7]
    ids = [f"r{i:03d}" for i in rng.permutation(900)]
    questions = pa.table({"question_id": [f"q{i:03d}" for i in range(450)], "embedding": asked.tolist()})
    rows = pa.table({"id": ids, "training_data_type": ["sql"] * 900, "scope": ["all"] * 900, "embedding": stored.tolist()})
    picked = []

    def scorer(block, part, k, least):
        assert block.num_rows <= 100 and block.num_rows * part.num_rows <= 8000
        q, r, d = nearest.candidates(metric, block, part, k, least)
        picked.append((bool(np.isfinite(least).all()), len(q)))
        return q, r, d

    want = [(f"q{q:03d}", *x[::-1]) for q in range(450) for x in sorted((round(distance(metric, asked[q], p), 6) + 0.0, i) for i, p in zip(ids, stored))[:3]]
    for same in (None, nearest.equal_rows):
        picked.clear()
        hits = blocks._named(blocks._hits(scorer, questions, rows, 3, same), questions).to_pandas()
        assert sorted(zip(hits["question_id"], hits["id"], hits["distance"])) == sorted(want)
    later = [n for known, n in picked if known]
    assert len(later) > len(picked) / 2 and sum(later) < 3 * 450 * len(picked) / 5  # before, each of 5 and more tiles gave 3 a question


def test_batches_of_a_scan_hold_the_best_so_far():
    rows = pa.table({"id": [f"r{i:03d}" for i in range(300)], "training_data_type": KINDS, "scope": KINDS, "embedding": [list(map(float, p)) for p in POINTS]})
    questions = pa.table({"question_id": [f"q{i:02d}" for i in range(40)], "embedding": ASKED.tolist()})
    k, kept = {"sql": 4, "ddl": 2, "documentation": 0}, None
    for start in range(0, 300, 37):
        kept = blocks._hits(partial(nearest.candidates, "l2"), questions, rows.slice(start, 37), k, nearest.equal_rows, kept if kept is not None else blocks.KEPT.empty_table())
        assert kept.num_rows <= 40 * 6
    hits = blocks._named(kept, questions).to_pandas()
    assert sorted(zip(hits["question_id"], hits["id"], hits["distance"])) == [r[:3] for r in brute("l2", k, lambda kind: kind)]


def test_questions_out_of_the_corpus_itself(tables):
    """Both sides share columns then, which the co-grouped tasks have to see on either side."""
    corpus = tables[1]
    asked = corpus.filter("id >= 'r200'").select(F.col("id").alias("question_id"), "embedding")
    assert got(nearest.knn(asked, corpus, 1, **CELLS)) == [(f"r{i}", f"r{i}", 0.0, 1) for i in range(200, 300)]
    assert got(nearest.knn(asked, corpus, 3, **CELLS, cell_pairs=500)) == got(nearest.knn(asked, corpus, 3))


def test_vectors_are_made_once(spark, tmp_path):
    """What has no vector is left out without making the others twice, and questions are made once for all that reads them."""
    def model():
        def run(texts, task):
            with (tmp_path / f"{task}-{os.getpid()}").open("a") as said:
                said.write("x" * len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return run

    rows = spark.createDataFrame([(str(i), "sql", "a" * i if i else None) for i in range(30)], "id string, training_data_type string, t string")
    asked = spark.createDataFrame([("n", None), ("p", "aaa"), ("q", "aaaa")], "question_id string, t string")
    made = lambda task: sum(p.stat().st_size for p in tmp_path.glob(f"{task}-*"))
    for sizes, questions, stored in (({}, 2, 29), ({"max_broadcast": 0, "cell_weight": 20}, 4, 29 * 3)):  # cells weigh the rows first
        hits = nearest.knn(embed(asked, "t", model, task="question"), embed(rows, "t", model), 1, **sizes)
        assert sorted((r["question_id"], r["id"]) for r in hits.collect()) == [("p", "3"), ("q", "4")]
        assert (made("question"), made("document")) == (questions, stored)


def test_memory_of_a_cell():
    """Equal rows are found without a wider copy of the vectors, distances are worked out for a bounded number of pairs."""
    def peak(work, *args):
        tracemalloc.start()
        try:
            work(*args)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    vectors = np.random.default_rng(3).normal(size=(20_000, 64)).astype(np.float32)
    rows = pa.table({"embedding": pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, 64, dtype=np.int32), vectors.ravel())})
    assert peak(nearest.equal_rows, rows) < 4 * vectors.nbytes
    asked, stored = vectors[:100].astype(float), np.repeat(vectors[:1].astype(float), 1000, axis=0)
    assert peak(nearest.near_pairs, "l2", asked, stored, 1) < 40e6


def test_keywords(spark):
    texts = ["red fox", "red red fox jumps", "blue sky", "", "a fox and a dog", "red"] + ["filler the words"] * 30 + ["red fox"] * 10
    corpus = spark.createDataFrame([(f"d{i:02d}", "documentation", t) for i, t in enumerate(texts)], "id string, training_data_type string, content string").repartition(4)
    asked = spark.createDataFrame([("a", "Red fox?"), ("b", "the sky"), ("c", "nothing here"), ("d", "")], "question_id string, question string")
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(query, w):
        total = 0.0
        for term in set(query):
            d = sum(term in x for x in words)
            f = w.count(term)
            if f:
                total += np.log(1 + (len(words) - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return round(total, 6)

    want = []
    for name, query in (("a", ["red", "fox"]), ("b", ["the", "sky"]), ("c", ["nothing", "here"]), ("d", [])):
        scored = sorted((-score(query, w), f"d{i:02d}") for i, w in enumerate(words) if score(query, w) > 0)
        want += [(name, i, -s, n + 1) for n, (s, i) in enumerate(scored[:4])]
    for sizes in ({}, {"max_broadcast": 0, "cell_weight": 20}, {"statistics": term_statistics(corpus)}):
        rows = sorted((r["question_id"], r["id"], r["score"], r["rank"]) for r in bm25(asked, corpus, 4, **sizes).collect())
        assert rows == sorted(want)


def test_default_model(spark):
    df = spark.createDataFrame([("a\nb",), ("a b",), ("A B",), ("zzz",), (None,), ("",)], "t string")
    a, b, c, z, none, blank = (r[0] for r in embed(df, "t", hashed_grams(16)).select("embedding").collect())
    assert a == b == c != z and none is None and len(blank) == 16
    assert abs(sum(x * x for x in a) - 1) < 1e-5


def test_rerank_keeps_search_order_for_equal_scores(spark):
    hits = spark.createDataFrame(
        [("q", "a", "x", 1), ("q", "b", "y w", 2), ("q", "c", "w", 3), ("q", "d", "z", 4)], "question_id string, id string, content string, rank int"
    ).withColumn("question", F.lit("w"))
    assert [(r["id"], r["rank"]) for r in retrieval.rerank(hits, 3).orderBy("rank").collect()] == [("c", 1), ("b", 2), ("a", 3)]


def test_model_scorer(spark):
    def lengths():
        return lambda questions, contents: [float(len(c) - len(q)) for q, c in zip(questions, contents)]

    hits = spark.createDataFrame([("q", "a", "xx", 1), ("q", "b", "yyyy", 2)], "question_id string, id string, content string, rank int")
    best = retrieval.rerank(hits.withColumn("question", F.lit("w")), 1, retrieval.model_scorer(lengths)).collect()
    assert [(r["id"], r["score"]) for r in best] == [("b", 3.0)]


def test_several_queries_label_gaps(spark):
    """Labels count suggestions and hits from zero and keep the gaps duplicates leave."""
    corpus = spark.createDataFrame([("a", "ddl", "A", [0.0, 0.0]), ("b", "ddl", "B", [1.0, 0.0]), ("c", "ddl", "C", [0.0, 9.0])],
                                   "id string, training_data_type string, content string, embedding array<double>")
    hints = spark.createDataFrame([("q", 0, "x", "q#0", [0.0, 0.0]), ("q", 1, "y", "q#1", [1.0, 0.0])],
                                  "question_id string, i int, hint string, suggestion_id string, embedding array<double>")
    found = retrieval.multi_query(hints, corpus, 2, retrieval_threshold=0.5).collect()
    assert sorted(r["chunk"] for r in found) == ["0.0.A", "1.0.B"]


def test_starting_questions_and_context_of_nothing(spark, tables):
    corpus = tables[1].withColumns({"question": F.col("id"), "content": F.col("id")}).filter("training_data_type <> 'ddl'")
    asked = tables[0].withColumn("question", F.col("question_id"))
    row = retrieval.retrieve_context(asked, corpus, {"sql": 2, "documentation": 1}).orderBy("question_id").first()
    assert (len(row["pairs"]), len(row["ddl"]), len(row["documentation"])) == (2, 0, 1)
    assert retrieval.starter_questions(corpus, [0.0] * DIM, 3).count() == 3
