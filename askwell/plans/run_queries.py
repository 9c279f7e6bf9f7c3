"""Checks of running, profiling, learning, scoring and of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwell import schemas
from askwell.functions.sqltext import is_select
from askwell.operators import bootstrap, evaluation, profile
from askwell.operators import run as r
from askwell.operators.corpus import add_ddl, add_documentation, add_pairs, one_per_id
from askwell.operators.embedding import embed
from askwell.operators.nearest import knn
from askwell.operators.training import train
from askwell.plans import ask, inputs
from askwell.plans.oracle_parts import PAIRS, sql_id, sql_pair
from askwell.plans.registry import query
from askwell.session import shared_folder
from askwell.sources.readers import run_sql
from askwell.sources.store import CorpusStore
from askwell.streaming import jobs


@query("run_sql", """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderpriority""")
def run_sql_query(spark, sf_dir):
    inputs.views(spark, sf_dir, "orders", "customer")
    return run_sql(spark, """
        SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM askwell_orders
        WHERE o_custkey IN (SELECT c_custkey FROM askwell_customer WHERE c_acctbal > 0) GROUP BY o_orderpriority; """)


def _generated(spark, sf_dir):
    """A generated statement per flag and status of the line items; some do not run, some may not. Like
    responses of a model they are written first."""
    flags = inputs.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    flag = F.col("l_returnflag")
    sql = (
        F.when((flag == "N") & (F.col("l_linestatus") == "F"), "DROP TABLE askwell_lineitem")
        .when(flag == "N", "SELECT no_such_column FROM askwell_lineitem")
        .otherwise(F.concat(F.lit("SELECT l_suppkey, sum(l_quantity) FROM askwell_lineitem WHERE l_returnflag = '"), flag, F.lit("' GROUP BY l_suppkey;")))
    )
    made = flags.select(
        F.concat("l_returnflag", "l_linestatus").alias("question_id"), F.concat(F.lit("Quantity for "), flag, F.lit("?")).alias("question"), sql.alias("sql")
    )
    path = shared_folder(spark, "generated")
    made.write.parquet(path)
    return spark.read.parquet(path).withColumn("is_valid", is_select(F.col("sql")))


@query("run_generated", """
    WITH f AS (SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem GROUP BY 1, 2),
    n AS (SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
    SELECT f.f || f.s AS question_id, CASE WHEN f.f = 'N' AND f.s = 'F' THEN 'No SQL Generated' WHEN f.f = 'N' THEN 'SQL Unable to Run'
      ELSE 'SQL Ran Successfully' END AS status, CASE WHEN f.f <> 'N' THEN n.n END AS row_count, f.f = 'N' AND f.s <> 'F' AS failed
    FROM f JOIN n ON n.f = f.f""")
def run_generated(spark, sf_dir):
    inputs.views(spark, sf_dir, "lineitem")
    made = _generated(spark, sf_dir)
    runs = r.run_results(made, r.run_statements(spark, made))
    return runs.select("question_id", "status", "row_count", F.col("error").isNotNull().alias("failed"))


def copying_model():
    """A stand-in model: repeats the SQL of the nearest stored pair, in a fence."""
    def call(messages):
        stored = [x["content"] for x in messages if x["role"] == "assistant"]
        return f"This should do:\n```sql\n{stored[0]}\n```" if stored else "I cannot say."

    return call


@query("ask_batch", """
    WITH n AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
    SELECT DISTINCT o_orderpriority AS question_id, 'SQL Ran Successfully' AS status, (SELECT n FROM n WHERE p = o_orderpriority) AS row_count FROM orders""")
def ask_batch(spark, sf_dir):
    """A question per order priority against a corpus of pairs, tables and documents: search, prompt, model,
    extraction, run, and the pairs that gave rows stored."""
    inputs.views(spark, sf_dir, "orders")
    priorities = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    ask_for = F.concat(F.lit("Large orders of priority "), "p", F.lit("?"))
    sql = F.concat(F.lit("SELECT o_orderkey, o_totalprice FROM askwell_orders WHERE o_totalprice > 300000 AND o_orderpriority = '"), "p", F.lit("';"))
    pairs = add_pairs(priorities.select(ask_for.alias("question"), sql.alias("sql")), form="question")
    ddl = add_ddl(inputs.table(spark, sf_dir, "part").select(F.concat(F.lit("CREATE TABLE "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" (x int)")).alias("ddl")).distinct())
    docs = add_documentation(inputs.text_corpus(spark, sf_dir).withColumnRenamed("content", "documentation"))
    corpus = embed(pairs.unionByName(ddl).unionByName(docs), "embed_text")
    questions = embed(priorities.select(F.col("p").alias("question_id"), ask_for.alias("question")), "question", task="question")
    store = CorpusStore(spark, shared_folder(spark, "learnt"), schemas.CORPUS)
    runs = ask.ask_batch(spark, questions, corpus, copying_model, store=store, k=3)
    learnt = store.read().select("question").distinct()
    return runs.join(learnt, "question", "left_semi").select("question_id", "status", "row_count")


@query("train_then_ask", f"""
    WITH {PAIRS}, known AS (SELECT DISTINCT question, sql FROM pairs), ids AS (SELECT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id FROM known)
    SELECT id AS question_id, id, CAST(0 AS DOUBLE) AS distance FROM ids""")
def train_then_ask(spark, sf_dir):
    """Documents and pairs learnt in two rounds, the pairs twice; asked for by its own text, each pair is the first hit."""
    store = CorpusStore(spark, shared_folder(spark, "trained"), schemas.CORPUS_VECTORS)
    none = F.lit(None).cast("string")
    texts = inputs.text_corpus(spark, sf_dir).select(none.alias("question"), none.alias("sql"), none.alias("ddl"), F.col("content").alias("documentation"))
    train(store, texts)
    pairs = inputs.pairs(spark, sf_dir).select("question", "sql", none.alias("ddl"), none.alias("documentation"))
    for _ in range(2):
        train(store, pairs)
    stored = store.read()
    asked = stored.filter("training_data_type = 'sql'").select(F.col("id").alias("question_id"), "embed_text")
    hits = knn(embed(asked, "embed_text", task="question"), stored, 1)
    return hits.select("question_id", "id", "distance")


@query("train_bare_statements", f"""
    WITH {PAIRS}, made AS (SELECT DISTINCT 'What has ' || length(sql) || ' characters?' AS question, sql FROM pairs)
    SELECT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id, question, sql AS content FROM made""")
def train_bare_statements(spark, sf_dir):
    """Statements without a question: a model makes one for each, and the pairs are stored."""
    from askwell.plans.context_queries import echo_model

    store = CorpusStore(spark, shared_folder(spark, "bare"), schemas.CORPUS)
    none = F.lit(None).cast("string")
    bare = inputs.pairs(spark, sf_dir).select(none.alias("question"), "sql", none.alias("ddl"), none.alias("documentation"))
    train(store, bare, asker=echo_model, answers=shared_folder(spark, "made"))
    return store.read().select("id", "question", "content")


def words_model():
    """A stand-in model: suggests the question's words, one per line."""
    return lambda messages: "\n".join(messages[-1]["content"].split("Question: ")[1].split())


@query("suggested_context")
def suggested_context(spark, sf_dir):
    """Context of benchmark questions: DDL by suggested columns, pairs and documents by the question."""
    ddl = add_ddl(bootstrap.create_ddl(inputs.column_descriptions(spark, sf_dir)))
    docs = add_documentation(inputs.text_corpus(spark, sf_dir).withColumnRenamed("content", "documentation"))
    pairs = add_pairs(inputs.pairs(spark, sf_dir))
    corpus = embed(pairs.unionByName(ddl).unionByName(docs), "embed_text")
    asked = embed(inputs.benchmark_questions(spark, sf_dir), "question", task="question")
    context = ask.suggested_context(asked, corpus, words_model, k=3)
    return context.select(
        "question_id", F.size("pairs").alias("pairs"), F.size("documentation").alias("documents"), F.size("ddl").alias("tables"),
        F.substring(F.get("ddl", F.lit(0))["content"], 1, 4).alias("first_label"),
    )


_PAIR = sql_pair("question", "sql")
_RUNS = f"""
runs AS (SELECT 'How often did user ' || user_id || ' ' || event_type || '?' AS question,
  'SELECT count(*) FROM events WHERE user_id = ' || user_id || ' AND event_type = ''' || event_type || '''' AS sql,
  CASE event_type WHEN 'signup' THEN 'No SQL Generated' WHEN 'error' THEN 'SQL Unable to Run' WHEN 'purchase' THEN 'Flagged for Review'
    ELSE 'SQL Ran Successfully' END AS category, CAST(floor(value) AS BIGINT) AS row_count, ts FROM events)"""
_TRAINED = f"""WITH {_RUNS} SELECT DISTINCT {sql_id(_PAIR, 'sql')} AS id, question, sql AS content FROM runs
    WHERE category = 'SQL Ran Successfully' AND row_count > 0"""


@query("auto_train", _TRAINED)
def auto_train(spark, sf_dir):
    """The log holds most pairs many times; each is learnt once."""
    return one_per_id(r.auto_train(inputs.run_log(spark, sf_dir))).select("id", "question", "content")


def _event_stream(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("auto_train_stream", _TRAINED)
def auto_train_stream(spark, sf_dir):
    """The same, from the log as a stream."""
    folder = shared_folder(spark, "stream")
    store = CorpusStore(spark, f"{folder}/corpus", schemas.CORPUS)
    jobs.start_auto_train(inputs.as_runs(_event_stream(spark, sf_dir)), store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select("id", "question", "content")


_WINDOWS = f"""{_RUNS}, w AS (SELECT date_trunc('hour', ts) AS start, category, count(*) AS n FROM runs GROUP BY 1, 2)"""


@query("outcome_windows", f"WITH {_WINDOWS} SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, category, n FROM w")
def outcome_windows(spark, sf_dir):
    counts = jobs.outcome_windows(inputs.run_log(spark, sf_dir).withColumnRenamed("status", "category"))
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("outcome_stream", f"""
    WITH {_WINDOWS} SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, category, n FROM w
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def outcome_stream(spark, sf_dir):
    """The counts from a stream, appended once a window is closed; the windows still open are not there."""
    folder = shared_folder(spark, "outcomes")
    counts = jobs.outcome_windows(inputs.as_runs(_event_stream(spark, sf_dir)).withColumnRenamed("status", "category"))
    sink = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start(f"{folder}/counts").awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("preview_json", """
    SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice
      || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '"}' AS record FROM orders ORDER BY o_orderkey LIMIT 10""")
def preview_json(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return profile.preview_json(orders, ["o_orderkey"])


@query("markdown_preview", """
    SELECT '| c_custkey | c_name | c_acctbal |' || chr(10) || '|:--|:--|:--|' || chr(10)
      || string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_acctbal || ' |', chr(10) ORDER BY c_custkey) AS markdown
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 25)""")
def markdown_preview(spark, sf_dir):
    return profile.markdown(inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])


def _results(spark, sf_dir):
    """Results of every shape a chart is chosen for."""
    items, customers = inputs.table(spark, sf_dir, "lineitem"), inputs.table(spark, sf_dir, "customer")
    return {
        "two numbers": items.select("l_returnflag", "l_quantity", "l_extendedprice"),
        "one number": items.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity")),
        "few texts": customers.select("c_mktsegment"),
        "many texts": customers.select("c_name"),
        "one row": items.agg(F.sum("l_quantity").alias("quantity")),
        "dates": items.select("l_shipdate"),
    }


@query("should_chart", """
    SELECT * FROM (VALUES ('two numbers', (SELECT count(*) > 1 FROM lineitem)), ('one number', (SELECT count(DISTINCT l_returnflag) > 1 FROM lineitem)),
      ('few texts', false), ('many texts', false), ('one row', false), ('dates', false)) t(result, should_chart)""")
def should_chart(spark, sf_dir):
    out = None
    for name, df in _results(spark, sf_dir).items():
        part = profile.should_chart(df).withColumn("result", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("chart_spec", """
    SELECT * FROM (VALUES ('two numbers', 'scatter', 'l_quantity', 'l_extendedprice'), ('one number', 'bar', 'l_returnflag', 'quantity'),
      ('few texts', CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) < 10 THEN 'pie' ELSE 'line' END,
        CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) < 10 THEN 'c_mktsegment' END, NULL),
      ('many texts', CASE WHEN (SELECT count(DISTINCT c_name) FROM customer) < 10 THEN 'pie' ELSE 'line' END,
        CASE WHEN (SELECT count(DISTINCT c_name) FROM customer) < 10 THEN 'c_name' END, NULL),
      ('one row', 'line', NULL, NULL), ('dates', 'line', NULL, NULL)) t(result, kind, x, y)""")
def chart_spec(spark, sf_dir):
    out = None
    for name, df in _results(spark, sf_dir).items():
        part = profile.chart_spec(df).withColumn("result", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("schema_text", """
    SELECT 'l_returnflag string' || chr(10) || 'quantity double' || chr(10) || 'n bigint' AS schema, count(DISTINCT l_returnflag) AS result_rows FROM lineitem""")
def schema_text(spark, sf_dir):
    result = inputs.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return result.agg(F.lit(profile.schema_text(result)).alias("schema"), F.count(F.lit(1)).alias("result_rows"))


FIELDS = ["signup", "error", "click", "view", "purchase"]


@query("question_history", "SELECT CAST(user_id AS VARCHAR) AS id, " + ", ".join(
    f"last(CAST(value AS VARCHAR) ORDER BY ts, event_id) FILTER (WHERE event_type = '{f}') AS {f}" for f in FIELDS
) + ", concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE event_type = '{f}') = 0 THEN '{f}' END" for f in ("signup", "purchase"))
    + ") AS missing FROM events GROUP BY user_id")
def question_history(spark, sf_dir):
    log = inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"),
        "ts", F.col("event_id").alias("seq"),
    )
    return profile.question_history(log, FIELDS, ["signup", "purchase"])


@query("elapsed", """
    SELECT user_id, event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1, 2""")
def elapsed(spark, sf_dir):
    return profile.elapsed(inputs.table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("null_profile", """
    WITH t AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.toxic = 1 THEN 1 END AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, unnest([
      round(count(*) FILTER (WHERE doc_id IS NULL) * 100.0 / count(*), 2), round(count(*) FILTER (WHERE lang IS NULL) * 100.0 / count(*), 2),
      round(count(*) FILTER (WHERE quality IS NULL) * 100.0 / count(*), 2), round(count(*) FILTER (WHERE toxic IS NULL) * 100.0 / count(*), 2)]) AS null_pct FROM t""")
def null_profile(spark, sf_dir):
    marked = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang").join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.null_profile(marked.select("doc_id", "lang", "quality", F.when(F.col("toxic") == 1, 1).alias("toxic")))


TEMPLATE = {
    "name": "revenue_by_status",
    "sql": """SELECT l_linestatus, round(sum(l_extendedprice), 2) AS revenue FROM askwell_lineitem
              WHERE l_returnflag = :flag AND l_quantity >= :least GROUP BY l_linestatus""",
    "arguments": [
        {"name": "flag", "type": "string", "available": ["A", "N", "R"]},
        {"name": "least", "type": "number"},
    ],
}


@query("run_template", """
    SELECT l_linestatus, round(sum(l_extendedprice), 2) AS revenue FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 GROUP BY l_linestatus""")
def run_template(spark, sf_dir):
    inputs.views(spark, sf_dir, "lineitem")
    return profile.run_template(spark, TEMPLATE, {"flag": "R", "least": 10})


@query("accuracy_stats", f"""
    WITH {_RUNS} SELECT category, count(*) AS n, (SELECT count(*) FROM runs) AS num_questions FROM runs GROUP BY category""")
def accuracy_stats(spark, sf_dir):
    stats = profile.accuracy_stats(inputs.run_log(spark, sf_dir).withColumnRenamed("status", "category"))
    return stats.select("num_questions", F.explode("data").alias("category", "n"))


@query("accuracy_cube", """
    WITH t AS (SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'static' ELSE 'retrieved' END AS strategy,
      CASE WHEN value > 60 THEN 1 ELSE 0 END AS correct FROM events)
    SELECT model, strategy, CAST(GROUPING(model, strategy) AS INT) AS level, count(*) AS trials, round(avg(correct), 6) AS accuracy FROM t GROUP BY CUBE (model, strategy)""")
def accuracy_cube(spark, sf_dir):
    strategies = F.array(*[F.lit(s) for s in evaluation.STRATEGIES])
    trials = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), F.element_at(strategies, (F.col("user_id") % 3 + 1).cast("int")).alias("strategy"),
        (F.col("value") > 60).cast("int").alias("correct"),
    )
    return evaluation.accuracy_cube(trials)


_SIDES = """
a AS (SELECT o_orderpriority AS c0, CAST(round(o_totalprice, -4) AS DOUBLE) AS c1 FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderpriority AS c0, CAST(round(o_totalprice, -4) AS DOUBLE) AS c1 FROM orders WHERE o_orderstatus = 'O')"""


@query("result_diff", f"""
    WITH {_SIDES} SELECT 'got' AS side, c0, c1, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
    UNION ALL SELECT 'expected', c0, c1, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def result_diff(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.round("o_totalprice", -4).alias("price"))
    closed, still_open = (orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O"))
    return evaluation.result_diff(closed, still_open)


@query("row_count_check", """
    SELECT count(*) AS row_count, count(*) = 10 AS passed FROM (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC LIMIT 10)""")
def row_count_check(spark, sf_dir):
    best = inputs.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x")).orderBy(F.desc("x")).limit(10)
    return evaluation.same_row_count(best, 10)


@query("json_records", """
    SELECT '{"n_nationkey":' || n_nationkey || ',"customers":' || count(c_custkey) || '}' AS value
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def json_records(spark, sf_dir):
    from askwell.sources.sinks import write_json

    path = shared_folder(spark, "json")
    counts = inputs.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    nations = inputs.table(spark, sf_dir, "nation").select("n_nationkey")
    counts = nations.join(counts, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"))
    write_json(counts, path)
    return spark.read.text(path)
