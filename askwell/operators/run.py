"""Running generated SQL and learning from what worked."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.functions.sqltext import is_select
from askwell.operators.bootstrap import markdown_header, markdown_line
from askwell.operators.context import MAX_TOKENS
from askwell.operators.corpus import add_pairs
from askwell.operators.profile import markdown, outcome
from askwell.schemas import RUN_RESULT, SQL_RAN, SQL_UNABLE_TO_RUN
from askwell.session import shared_folder
from askwell.sources.readers import run_sql

STATUS_BATCH = 500
CHARS_PER_TOKEN = 4
#: Column of stored results: the row's place in the result.
POSITION = "_position"


def _file_names(columns: list[str]) -> list[str]:
    """Names fit for a file: other characters become ``_``, repeats get their place."""
    plain = ["".join(ch if ch.isalnum() or ch == "_" else "_" for ch in c) for c in columns]
    seen = [p.lower() for p in plain]
    return [p if seen.count(p.lower()) == 1 else f"{p}_{i}" for i, p in enumerate(plain)]


def _within(stored: DataFrame, columns: list[str], tokens: int) -> str:
    """The result as markdown as far as ``tokens`` go, and how many rows are left out then. Rows come to the driver one by
    one, until there is no more room."""
    line = markdown_line([F.col(c) for c in columns]).alias("line")
    shown, room, count = [], tokens * CHARS_PER_TOKEN - len(markdown_header(columns)), stored.count()
    for row in stored.orderBy(POSITION).limit(max(1, room)).select(line).toLocalIterator():
        room -= len(row["line"]) + 1
        if room < 0:
            break
        shown.append(row["line"])
    left = count - len(shown)
    return markdown_header(columns) + "\n".join(shown + ([f"({left} of {count} rows are not shown)"] if left else []))


def _run_one(spark: SparkSession, sql: str, path: str, preview_rows: int | None, tokens: int) -> tuple:
    try:
        result = run_sql(spark, sql)
        named = result.toDF(*_file_names(result.columns))
        # numbers rise along the rows as the statement gave them
        named.withColumn(POSITION, F.monotonically_increasing_id()).write.parquet(path)
        stored = spark.read.parquet(path)
        count = stored.count()
    except PySparkException as exc:
        return (sql, SQL_UNABLE_TO_RUN, None, str(exc).split("\n")[0], None, None)
    try:
        if preview_rows is None:
            preview = _within(stored, named.columns, tokens)
        else:
            preview = markdown(stored, [POSITION], preview_rows, named.columns).first()["markdown"] if preview_rows else None
        return (sql, SQL_RAN, count, None, path, preview)
    except PySparkException as exc:  # the statement ran, its rows cannot be shown
        return (sql, SQL_RAN, count, f"no preview: {str(exc).split(chr(10))[0]}", path, None)


def _table(rows: list[tuple]) -> pa.Table:
    types = {"row_count": pa.int64()}
    fields = [pa.field(name, types.get(name, pa.string())) for name in RUN_RESULT.names]
    return pa.Table.from_pylist([dict(zip(RUN_RESULT.names, row)) for row in rows], pa.schema(fields))


def run_statements(
    spark: SparkSession, statements: DataFrame, folder: str | None = None, *, preview_rows: int | None = 0, preview_tokens: int = MAX_TOKENS, at_once: int = 8
) -> DataFrame:
    """Every distinct valid statement (sql, is_valid), run as a Spark job of its own: sql, status,
    row_count, error, result_path, preview.

    Statements come to the driver a few at a time, since only it can submit jobs, and ``at_once`` run side
    by side. Results are written, never collected, but for the ``preview_rows`` first rows as text (None: all, as far as
    ``preview_tokens`` go), in the order the statement gave them (column ``_position`` of the stored result). Only statements that read data are run.
    """
    folder = folder or shared_folder(spark, "results")
    wanted = statements.filter("is_valid").select("sql").distinct()
    wanted.write.parquet(f"{folder}/statements")
    todo = enumerate(spark.read.parquet(f"{folder}/statements").toLocalIterator())
    ran = False
    with ThreadPoolExecutor(at_once) as pool:
        while chunk := list(islice(todo, STATUS_BATCH)):
            jobs = [
                pool.submit(_run_one, spark, row["sql"], f"{folder}/result-{number}", preview_rows, preview_tokens) for number, row in chunk
            ]
            rows = [job.result() for job in jobs]
            spark.createDataFrame(_table(rows)).coalesce(1).write.mode("append").parquet(f"{folder}/status")
            ran = True
    if not ran:
        return spark.createDataFrame([], RUN_RESULT)
    return spark.read.schema(RUN_RESULT).parquet(f"{folder}/status")


def run_results(extracted: DataFrame, statuses: DataFrame) -> DataFrame:
    """Outcome per question: question_id, question, sql, status, row_count, error, result_path."""
    joined = extracted.select("question_id", "question", "sql", "is_valid").join(statuses, "sql", "left")
    status = F.when(F.col("status").isNotNull(), F.col("status")).otherwise(outcome(F.when(F.col("is_valid"), F.col("sql")), F.lit(None)))
    return joined.select("question_id", "question", "sql", status.alias("status"), "row_count", "error", "result_path")


def previews(spark: SparkSession, statements: DataFrame, n: int | None = None, tokens: int = MAX_TOKENS) -> DataFrame:
    """Distinct statements (sql) with their rows as markdown: sql, preview, error. The first ``n`` rows, or all of them as far as
    ``tokens`` go."""
    checked = statements.withColumn("is_valid", is_select(F.col("sql")))
    seen = run_statements(spark, checked, preview_rows=n, preview_tokens=tokens).select("sql", "preview", "error")
    no_reader = F.when(F.col("preview").isNull(), F.coalesce("error", F.lit("not a statement that reads data")))
    return statements.join(seen, "sql", "left").select("sql", "preview", no_reader.alias("error"))


def successful(runs: DataFrame) -> DataFrame:
    """Runs that gave rows."""
    return runs.filter((F.col("status") == SQL_RAN) & (F.col("row_count") > 0))


def auto_train(runs: DataFrame) -> DataFrame:
    """Corpus rows of the question/SQL pairs that gave rows."""
    return add_pairs(successful(runs))
