"""Checks of search and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwell.functions.text import one_line
from askwell.functions.vectors import norm
from askwell.operators import ivf, nearest, pq, retrieval
from askwell.operators.embedding import embed, hashed_grams, projection_2d
from askwell.operators.keyword_index import search_index
from askwell.operators.layout import layout_2d, trustworthiness
from askwell.plans import inputs
from askwell.plans.oracle_parts import COSINE, DOT, HITS, L2, L2SQ, VECTORS, knn, overlap, words
from askwell.plans.registry import query
from askwell.session import shared_folder


def _both(spark, sf_dir):
    return inputs.topic_questions(spark, sf_dir), inputs.vectors(spark, sf_dir)


@query("knn_l2", f"WITH {VECTORS}, {knn(L2)} SELECT {HITS} FROM hits")
def knn_l2(spark, sf_dir):
    return nearest.knn(*_both(spark, sf_dir), 10, "l2")


@query("knn_cosine", f"WITH {VECTORS}, {knn(COSINE)} SELECT {HITS} FROM hits")
def knn_cosine(spark, sf_dir):
    return nearest.knn(*_both(spark, sf_dir), 10, "cosine")


@query("knn_dot", f"WITH {VECTORS}, {knn(DOT)} SELECT {HITS} FROM hits")
def knn_dot(spark, sf_dir):
    return nearest.knn(*_both(spark, sf_dir), 10, "dot")


PER_KIND = {"sql": 5, "ddl": 3, "documentation": 10}


@query("knn_per_kind", f"""
    WITH {VECTORS}, {knn(L2, "CASE training_data_type WHEN 'sql' THEN 5 WHEN 'ddl' THEN 3 ELSE 10 END", "question_id, training_data_type")}
    SELECT {HITS} FROM hits""")
def knn_per_kind(spark, sf_dir):
    return nearest.knn(*_both(spark, sf_dir), PER_KIND)


@query("knn_prefilter", f"""WITH {VECTORS}, {knn(L2, "5", where="c.kind = 'ddl'")} SELECT {HITS} FROM hits""")
def knn_prefilter(spark, sf_dir):
    return nearest.search(*_both(spark, sf_dir), 5, kind="ddl")


@query("knn_postfilter", f"WITH {VECTORS}, {knn(L2, '5')} SELECT {HITS} FROM hits WHERE training_data_type = 'ddl'")
def knn_postfilter(spark, sf_dir):
    return nearest.search(*_both(spark, sf_dir), 5, kind="ddl", prefilter=False)


@query("knn_threshold", f"WITH {VECTORS}, {knn(L2SQ)} SELECT {HITS} FROM hits WHERE distance < 0.93")
def knn_threshold(spark, sf_dir):
    return nearest.within(nearest.knn(*_both(spark, sf_dir), 10, "l2sq"), 0.93)


@query("score_passed", f"""
    WITH {VECTORS}, {knn(COSINE)} SELECT question_id, id, distance < 0.9 AS by_distance, 1 - distance > 0.1 AS by_score FROM hits""")
def score_passed(spark, sf_dir):
    hits = nearest.knn(*_both(spark, sf_dir), 10, "cosine")
    return hits.select(
        "question_id", "id", nearest.score_passed(F.col("distance"), False, retrieval_threshold=0.9).alias("by_distance"),
        nearest.score_passed(1 - F.col("distance"), True).alias("by_score"),
    )


def _reranked(k: int, fetch: int, cut: str = "true") -> str:
    return f"""WITH {VECTORS}, {knn(L2SQ, str(fetch), rows='corpus')},
    scored AS (SELECT h.question_id, h.id, h.distance, h.rank, {overlap('t.question', 'c.content')} AS score
      FROM hits h JOIN corpus c ON c.id = h.id JOIN topics t ON t.question_id = h.question_id WHERE {cut})
    SELECT question_id, id, distance, score, CAST(place AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM scored) WHERE place <= {k}"""


@query("rerank_topk", _reranked(5, 15, "distance < 1.5"))
def rerank_topk(spark, sf_dir):
    found = retrieval.search_with_score(
        inputs.topic_questions(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 5, reranked=True
    )
    return found.select("question_id", "id", "distance", "score", "rank")


@query("rerank_wide", _reranked(10, 50))
def rerank_wide(spark, sf_dir):
    found = retrieval.rerank_wide(inputs.topic_questions(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 10)
    return found.select("question_id", "id", "distance", "score", "rank")


@query("merge_duplicates", f"""
    WITH {VECTORS}, {knn(L2, name='a', rows='corpus')}, {knn(COSINE, name='b', rows='corpus')}
    SELECT m.question_id, m.id, round(avg(1 - m.distance), 8) AS score, any_value(c.content) AS content
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) m JOIN corpus c ON c.id = m.id GROUP BY m.question_id, m.id""")
def merge_duplicates(spark, sf_dir):
    """Two searches find partly the same; each document counts once, with its mean score."""
    asked, corpus = inputs.topic_questions(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir)
    found = [nearest.with_content(nearest.knn(asked, corpus, 10, metric), corpus, "content") for metric in ("l2", "cosine")]
    merged = nearest.merge_duplicates(found[0].unionByName(found[1]).withColumn("score", 1 - F.col("distance")))
    return merged.select("question_id", "id", F.round("score", 8).alias("score"), "content")


def _hints(spark, sf_dir):
    """Each topic's suggestions: itself and the next two labels; a suggestion's vector is that topic's."""
    topics = inputs.topic_questions(spark, sf_dir)
    label = F.col("question_id").cast("int")
    name = lambda n: F.concat(F.lit("of the label "), ((label + n) % 10).cast("string"))
    said = topics.select("question_id", F.concat_ws("\n", name(0), name(1), name(2)).alias("response"))
    vectors = topics.select(F.concat(F.lit("of the label "), "question_id").alias("hint"), "embedding")
    return retrieval.suggestions(said).join(vectors, "hint")


_HINTS = f"""{VECTORS},
asked AS (SELECT t.question_id AS topic, i, t.question_id || '#' || i AS question_id, o.v, 'of the label ' || o.question_id AS hint
  FROM topics t, range(0, 3) r(i) JOIN topics o ON o.question_id = CAST((CAST(t.question_id AS INT) + i) % 10 AS VARCHAR))"""


@query("multi_query", f"""
    WITH {_HINTS}, {knn(L2SQ, '5', rows='corpus', asked='asked')},
    cut AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) - 1 AS j FROM hits WHERE distance < 0.92),
    seen AS (SELECT a.topic AS question_id, a.i, h.j, h.id, h.distance AS score, c.content,
      row_number() OVER (PARTITION BY a.topic, c.content ORDER BY a.i, h.j) AS n
      FROM cut h JOIN asked a ON a.question_id = h.question_id JOIN corpus c ON c.id = h.id)
    SELECT question_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, id, score, i || '.' || j || '.' || content AS chunk FROM seen WHERE n = 1""")
def multi_query(spark, sf_dir):
    return retrieval.multi_query(_hints(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 5, retrieval_threshold=0.92)


@query("multi_query_reranked", f"""
    WITH {_HINTS}, {knn(L2SQ, '15', rows='corpus', asked='asked')},
    scored AS (SELECT h.*, c.content, {overlap('a.hint', 'c.content')} AS score FROM hits h JOIN asked a ON a.question_id = h.question_id
      JOIN corpus c ON c.id = h.id WHERE h.distance < 1.5),
    cut AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) - 1 AS j FROM scored),
    seen AS (SELECT a.topic AS question_id, a.i, h.j, h.id, h.score, h.content,
      row_number() OVER (PARTITION BY a.topic, h.content ORDER BY a.i, h.j) AS n
      FROM cut h JOIN asked a ON a.question_id = h.question_id WHERE h.j < 5 AND h.score > 0.03)
    SELECT question_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, id, score, i || '.' || j || '.' || content AS chunk FROM seen WHERE n = 1""")
def multi_query_reranked(spark, sf_dir):
    return retrieval.multi_query(
        _hints(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 5, reranked=True, rerank_threshold=0.03
    )


@query("bm25", f"""
    WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {words('text')} AS w FROM documents),
    facts AS (SELECT count(*) AS nd, avg(len(w)) AS av FROM d),
    tf AS (SELECT id, len(w) AS n, term, count(*) AS f FROM (SELECT id, w, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
    q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS question_id, unnest({words('text')}) AS term FROM benchmark),
    s AS (SELECT q.question_id, tf.id, round(sum(ln(1 + (nd - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av))), 6) AS score
      FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term, facts GROUP BY q.question_id, tf.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT question_id, 'documentation' AS training_data_type, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def bm25_query(spark, sf_dir):
    """From postings that are written once for each folder and session."""
    return search_index(inputs.keyword_index(spark, sf_dir), inputs.benchmark_questions(spark, sf_dir), 10)


def _index(corpus, centres):
    """The lists, written as one would keep them."""
    path = shared_folder(corpus.sparkSession, "lists")
    ivf.build_lists(corpus, centres).write.partitionBy("list_id").parquet(path)
    fields = "id string, training_data_type string, embedding array<float>, label int, list_id string"
    return corpus.sparkSession.read.schema(fields).parquet(path)


@query("ivf_knn", f"""
    WITH {VECTORS},
    near AS (SELECT c.id, t.question_id AS list_id, row_number() OVER (PARTITION BY c.id
      ORDER BY round(list_distance(c.v, t.v), 6), t.question_id) AS n FROM vectors c, topics t),
    asked AS (SELECT v.id AS question_id, v.v, n.list_id FROM vectors v JOIN near n ON n.id = v.id AND n.n <= 3),
    listed AS (SELECT v.*, n.list_id FROM vectors v JOIN near n ON n.id = v.id AND n.n = 1),
    {knn(L2, '10', rows='listed', asked='asked', where='q.list_id = c.list_id')} SELECT {HITS} FROM hits""")
def ivf_query(spark, sf_dir):
    """Every vector as a question; the topics are the centres, three lists are probed."""
    topics, corpus = _both(spark, sf_dir)
    centres = topics.select(F.col("question_id").alias("id"), "embedding")
    asked = corpus.select(F.col("id").alias("question_id"), "embedding")
    return ivf.ivf_knn(asked, _index(corpus, centres), centres, 10, 3)


@query("ivf_kmeans")
def ivf_kmeans(spark, sf_dir):
    """The same with centres fitted to the corpus."""
    topics, corpus = _both(spark, sf_dir)
    centres = ivf.fit_centres(corpus, 16)
    return ivf.ivf_knn(topics, _index(corpus, centres), centres, 10, 4)


def _pq(spark, sf_dir):
    """Every twentieth vector as a question, codes of all."""
    corpus = inputs.vectors(spark, sf_dir)
    asked = corpus.filter(F.col("id").cast("bigint") % 20 == 0).select(F.col("id").alias("question_id"), "embedding")
    books = pq.fit_codebooks(corpus)
    coded = pq.encode(corpus, books)
    path = shared_folder(spark, "codes")
    coded.write.parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    return asked, corpus, coded, pq.pq_knn(asked, coded, corpus, books, 10)


TWENTIETH = "asked AS (SELECT id AS question_id, v FROM vectors WHERE CAST(id AS BIGINT) % 20 = 0)"


@query("pq_knn", f"WITH {VECTORS}, {TWENTIETH}, {knn(L2, '10', rows='vectors', asked='asked')} SELECT {HITS} FROM hits")
def pq_query(spark, sf_dir):
    return _pq(spark, sf_dir)[3]


@query("pq_recall", f"""WITH {VECTORS}, {TWENTIETH}
    SELECT (SELECT count(*) FROM asked) AS questions, (SELECT count(*) FROM vectors) AS coded,
      16 * (SELECT count(*) FROM vectors) <= sum(4 * len(v)) / 16 AS codes_small, TRUE AS recall_95 FROM vectors""")
def pq_recall(spark, sf_dir):
    """Codes are at most 1/16 of the vectors' bytes, and 95 % of the ten nearest rows are found."""
    asked, corpus, coded, found = _pq(spark, sf_dir)
    enough = pq.recall(found, nearest.knn(asked, corpus, 10)) >= 0.95
    most = corpus.agg(F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0))).first()[0] / 16
    return coded.agg(F.count(F.lit(1)).alias("coded"), F.sum(F.length("code")).alias("codes")).select(
        F.lit(asked.count()).cast("bigint").alias("questions"), "coded", (F.col("codes") <= most).alias("codes_small"), F.lit(enough).alias("recall_95"))


@query("starter_questions", f"""
    WITH {VECTORS}, blank AS (SELECT '' AS question_id, list(0.125::DOUBLE) AS v FROM range(64)),
    {knn(L2, '10', rows='corpus', asked='blank', where="c.kind = 'sql'")}
    SELECT CAST(rank AS INT) AS rank, h.id, c.question FROM hits h JOIN corpus c ON c.id = h.id""")
def starter_questions(spark, sf_dir):
    return retrieval.starter_questions(inputs.embedded_corpus(spark, sf_dir), [0.125] * 64)


@query("retrieve_context", f"""
    WITH {VECTORS}, {knn(L2, "4", "question_id, training_data_type", rows='corpus')},
    found AS (SELECT h.*, c.question, c.content FROM hits h JOIN corpus c ON c.id = h.id)
    SELECT question_id, training_data_type, CAST(rank - 1 AS INT) AS position, id, question, content FROM found""")
def retrieve_context(spark, sf_dir):
    context = retrieval.retrieve_context(inputs.topic_questions(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 4)
    kinds = F.explode(F.map_from_arrays(
        F.array(F.lit("sql"), F.lit("ddl"), F.lit("documentation")), F.array("pairs", "ddl", "documentation")
    )).alias("training_data_type", "items")
    return context.select("question_id", kinds).select(
        "question_id", "training_data_type", F.posexplode("items").alias("position", "item")
    ).select("question_id", "training_data_type", "position", "item.*")


@query("hit_vectors", f"""
    WITH {VECTORS}, {knn(L2)} SELECT h.question_id, CAST(h.rank AS INT) AS rank, h.id, CAST(len(c.v) AS INT) AS dim,
      round(sqrt(list_inner_product(c.v, c.v)), 6) AS length FROM hits h JOIN vectors c ON c.id = h.id""")
def hit_vectors(spark, sf_dir):
    asked, corpus = _both(spark, sf_dir)
    rows = retrieval.hit_vectors(nearest.knn(asked, corpus, 10), corpus)
    return rows.select("question_id", "rank", "id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("length"))


@query("embed_docs", "SELECT doc_id, 64 AS dim, CAST(1 AS DOUBLE) AS length FROM documents")
def embed_docs(spark, sf_dir):
    """Every document's vector has the model's dimension and length 1."""
    rows = embed(inputs.table(spark, sf_dir, "documents"), "text", hashed_grams(64))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 3).alias("length"))


@query("search_texts")
def search_texts(spark, sf_dir):
    """Benchmark texts as questions against the documents, both embedded by the default model."""
    model = hashed_grams(64)
    asked = embed(inputs.benchmark_questions(spark, sf_dir), "question", model, task="question")
    stored = embed(inputs.text_corpus(spark, sf_dir), "content", model)
    return nearest.knn(asked, stored, 10, "cosine")


@query("projection_2d")
def projection(spark, sf_dir):
    """Topics, corpus and what was found for the topics, as points in the plane."""
    asked, corpus = _both(spark, sf_dir)
    hits = retrieval.hit_vectors(nearest.knn(asked, corpus, 5), corpus).select("id", F.lit("retrieved").alias("role"), "embedding")
    double = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    rows = (
        asked.select(F.col("question_id").alias("id"), F.lit("question").alias("role"), double)
        .unionByName(corpus.select("id", F.lit("corpus").alias("role"), double)).unionByName(hits.select("id", "role", double))
    )
    return projection_2d(rows)


@query("layout_2d")
def layout(spark, sf_dir):
    """All vectors in the plane, neighbours near each other."""
    return layout_2d(inputs.vectors(spark, sf_dir).select("id", "training_data_type", "embedding"))


@query("layout_trust", "SELECT count(*) AS placed, TRUE AS better_than_components FROM embeddings")
def layout_trust(spark, sf_dir):
    """Neighbours in the layout are neighbours among the vectors more often than those of the principal components."""
    rows = inputs.vectors(spark, sf_dir).select("id", F.lit("corpus").alias("role"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    path = shared_folder(spark, "layout")
    layout_2d(rows).write.parquet(path)
    placed = spark.read.parquet(path)
    better = trustworthiness(rows, placed) > trustworthiness(rows, projection_2d(rows))
    return placed.agg(F.count("x").alias("placed")).withColumn("better_than_components", F.lit(better))


@query("one_line", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def one_line_query(spark, sf_dir):
    """Texts as they go to an embedding model."""
    return inputs.table(spark, sf_dir, "documents").select("doc_id", one_line(F.col("text")).alias("text"))


def sizing_model():
    """A stand-in model that tells questions from documents: the text's length and line breaks, and 1 for a question."""
    def call(texts, task):
        return [[float(len(t)), float(t.count("\n")), float(task == "question")] for t in texts]

    return call


@query("embed_tasks", """
    SELECT 'document' AS task, doc_id AS id, CAST(length(text) AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS breaks, CAST(0 AS DOUBLE) AS asked FROM documents
    UNION ALL SELECT 'question', item_id, CAST(length(text) AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM benchmark""")
def embed_tasks(spark, sf_dir):
    """Stored texts and questions are embedded as such, each on one line."""
    stored = embed(inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "text", sizing_model)
    asked = embed(inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", sizing_model, task="question")
    rows = stored.select(F.lit("document").alias("task"), "id", "embedding").unionByName(asked.select(F.lit("question").alias("task"), "id", "embedding"))
    parts = [F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(("n", "breaks", "asked"))]
    return rows.select("task", "id", *parts)
