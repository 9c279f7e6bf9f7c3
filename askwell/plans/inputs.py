"""The given tables in the roles of corpus, questions, logs and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.operators.keyword_index import KeywordIndex, build_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer: a user turn and the assistant turn right after it. The join key is unique, so
    a long conversation does not end up in one task."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql"))
    return asked.join(told, ["conv_id", "turn"])


def column_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column descriptions from parts: 40 parts describe one table; no description or usage is 'nan'."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("t_"), (F.col("p_partkey") / 40).cast("bigint")).alias("table_name"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")).alias("column_name"),
        F.concat(F.lit("["), F.lower("p_type"), F.lit("]")).alias("data_type"),
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("nan").alias("description"),
        F.when(F.col("p_size") < 40, F.col("p_brand")).otherwise("nan").alias("usage"),
        F.col("p_partkey").alias("ordinal"),
    )


def info_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information schema rows from parts: database by type, schema by brand, 40 parts to a table."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.lower("p_type").alias("TABLE_CATALOG"),
        F.when(F.col("p_brand") == "Brand#1", "INFORMATION_SCHEMA").otherwise(F.replace("p_brand", F.lit("#"), F.lit("_")))
        .alias("TABLE_SCHEMA"),
        F.concat(F.lit("t_"), (F.col("p_partkey") / 40).cast("bigint")).alias("TABLE_NAME"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")).alias("COLUMN_NAME"),
        F.when(F.col("p_size") % 2 == 0, "NUMBER").otherwise("TEXT").alias("DATA_TYPE"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("COMMENT"),
        F.col("p_partkey").alias("ORDINAL_POSITION"),
    )


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log from events: who asked what kind of thing, rows produced, start time."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(
            F.lit("SELECT * FROM Sales_"), (F.col("user_id") % 3).cast("string"), F.lit(".Schema_"),
            F.col("event_type"), F.lit(".t WHERE user_id = "), F.col("user_id"),
        ).alias("QUERY_TEXT"),
        F.floor("value").cast("bigint").alias("ROWS_PRODUCED"),
        F.col("ts").alias("START_TIME"),
        F.col("event_id").alias("QUERY_ID"),
    )


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows with vectors: embeddings, their kind by label, the text of the document of that number."""
    vectors, texts = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit("sql"), F.lit("ddl"), F.lit("documentation")), (F.col("label") % 3 + 1).cast("int"))
    return vectors.join(texts, vectors["vec_id"] == texts["doc_id"]).select(
        F.col("vec_id").cast("string").alias("id"), kind.alias("training_data_type"),
        F.when(kind == "sql", F.concat(F.lit("Which "), F.col("lang"), F.lit(" text from "), F.col("source"), F.lit("?")))
        .alias("question"),
        F.col("text").alias("content"), "embedding", "label",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings alone: id, kind, vector."""
    kind = F.element_at(F.array(F.lit("sql"), F.lit("ddl"), F.lit("documentation")), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), kind.alias("training_data_type"), "embedding", "label"
    )


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per label: the mean vector of the label's embeddings."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (
        means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
        .select(
            F.col("label").cast("string").alias("question_id"),
            F.concat(F.lit("Is label "), F.col("label"), F.lit(" of a document known, and what is in the text?")).alias("question"),
            F.col("v.m").alias("embedding"),
        )
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("documentation").alias("training_data_type"),
        F.col("text").alias("content"), "lang", "source",
    )


_KEYWORD_INDEX: dict[tuple[str, str], KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The postings of the documents, written once for each folder and application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEYWORD_INDEX:
        _KEYWORD_INDEX[key] = build_index(text_corpus(spark, sf_dir))
    return _KEYWORD_INDEX[key]


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of three or four messages: a system text, a pair, and in later turns another system text. The
    third pair of a conversation has an empty prompt."""
    def said(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    basic = F.array(
        said("system", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))),
        said("user", F.col("question")), said("assistant", F.col("sql")),
    )
    later = F.concat(basic, F.array(said("system", F.concat(F.lit("Turn "), F.col("turn").cast("string")))))
    chosen = F.when(F.col("turn") == 0, basic).when(F.col("turn") == 4, F.slice(basic, 1, 0)).otherwise(later)
    return pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), chosen.alias("messages"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: every conversation turn wrapped in SQL, prose and fences, by its number."""
    turns = table(spark, sf_dir, "conversations")
    text, fence = F.col("text"), "```"
    forms = {
        0: F.concat(text, F.lit(" WITH a AS (SELECT 1) SELECT * FROM a; done")),
        1: F.concat(F.lit("Sure. SELECT x FROM t WHERE y = 1; and SELECT '"), text, F.lit("';")),
        2: F.concat(F.lit(f"{fence}sql\nselect a\\_b from t [x]\n{fence}"), text),
        3: F.concat(F.lit(f"{fence}sql\nselect 1\n{fence}"), text, F.lit(f"{fence}sql\nselect 2\n{fence}")),
        4: F.concat(F.lit("no query: "), text),
        5: F.concat(F.lit(fence), text, F.lit(fence)),
        6: F.concat(text, F.lit("\nselect lower from t\n")),
    }
    response = F.concat(F.lit("With x as (select 1) select 2; "), text)
    for turn, form in forms.items():
        response = F.when(F.col("turn") == turn, form).otherwise(response)
    return turns.select("conv_id", "turn", response.alias("response"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL and other texts, by the number of the turn."""
    turns = table(spark, sf_dir, "conversations")
    quoted = F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    forms = {
        0: F.concat(F.lit("SELECT "), quoted, F.lit(" AS x")),
        1: F.concat(F.lit("DELETE FROM t WHERE x = "), quoted, F.lit(";")),
        2: F.concat(F.lit("-- a note; DROP\n/* more; */ select "), quoted),
        3: F.concat(F.lit("WITH a AS (SELECT "), quoted, F.lit(" AS x) INSERT INTO t SELECT * FROM a")),
        4: F.concat(F.lit("with a as (select ("), quoted, F.lit(") as x), b as (select 1) select * from a, b")),
        5: F.concat(F.lit("INSERT INTO t VALUES ("), quoted, F.lit(", '; SELECT 1')")),
        6: F.concat(F.lit("UPDATE t SET a = "), quoted, F.lit("; SELECT 2")),
    }
    sql = F.concat(F.lit("The select statement is: "), quoted)
    for turn, form in forms.items():
        sql = F.when(F.col("turn") == turn, form).otherwise(sql)
    return turns.select("conv_id", "turn", sql.alias("sql"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs from events: the kind of event is the outcome, its value the number of rows."""
    return as_runs(table(spark, sf_dir, "events"))


def as_runs(events: DataFrame) -> DataFrame:
    from askwell import schemas as s

    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", s.NO_SQL_GENERATED).when(kind == "error", s.SQL_UNABLE_TO_RUN)
        .when(kind == "purchase", s.FLAGGED_FOR_REVIEW).otherwise(s.SQL_RAN)
    )
    return events.select(
        F.concat(F.lit("How often did user "), F.col("user_id"), F.lit(" "), kind, F.lit("?")).alias("question"),
        F.concat(F.lit("SELECT count(*) FROM events WHERE user_id = "), F.col("user_id"), F.lit(" AND event_type = '"), kind, F.lit("'"))
        .alias("sql"),
        status.alias("status"), F.floor("value").cast("bigint").alias("row_count"), "ts", "event_id",
    )


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for generated SQL to read."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"askwell_{name}")
