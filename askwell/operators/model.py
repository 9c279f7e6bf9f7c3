"""Model calls over tables of prompts, and the steps around them."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.sqltext import extract_code, extract_sql, is_select, without_numbers
from askwell.operators.context import TEMPLATES, fix_inputs, message, rewrite_inputs, task_prompt
from askwell.operators.retrieval import suggestions
from askwell.session import shared_folder

# A model: called once per partition, gives a function (list of messages) -> response text
ModelFactory = Callable[[], Callable[[list[dict]], str]]

INTERMEDIATE = "intermediate_sql"  # fixed value
NO_DATA_ACCESS = "The model may not see data; allow it to answer questions that need a look into the tables."


PROMPTS_PER_TASK = 64   # a lost task repeats so many calls at most
FEW_ANSWERS = 10_000    # answers that are broadcast, at most
ANSWER = "prompt string, response string, error string, asked_at timestamp"


def _patient(call: Callable, retries: int, wait: float) -> Callable:
    """``call`` tried again after waits that double: (result, error)."""
    def tried(prompt):
        for attempt in range(retries + 1):
            try:
                return call(prompt), None
            except Exception as exc:  # the row carries it
                error = f"{type(exc).__name__}: {exc}"
            if attempt < retries:
                time.sleep(wait * 2**attempt)
        return None, error

    return tried


def _answers(call: Callable, prompts: list, in_flight: int, retries: int, wait: float, together: int) -> list[tuple]:
    """(response, error) of each prompt, ``in_flight`` calls at a time, each of ``together`` prompts if that is more than one."""
    def one(messages):
        if not messages:
            raise ValueError("empty prompt")
        return call(messages)

    def several(group):
        found = list(call(group))
        if len(found) != len(group):
            raise ValueError(f"{len(found)} responses to {len(group)} prompts")
        return found

    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        if together <= 1:
            return list(pool.map(_patient(one, retries, wait), prompts))
        asked = [p for p in prompts if p]
        groups = [asked[i : i + together] for i in range(0, len(asked), together)]
        results = [(x, error) for group, (found, error) in zip(groups, pool.map(_patient(several, retries, wait), groups)) for x in (found or [None] * len(group))]
        each = iter(results)
        return [next(each) if p else (None, "ValueError: empty prompt") for p in prompts]


def generate_responses(
    prompts: DataFrame, model: ModelFactory, key: str = "question_id", tasks: int | None = None, *, answers: str | None = None,
    in_flight: int = 1, retries: int = 0, wait: float = 1.0, together: int = 1,
) -> DataFrame:
    """A response per prompt: ``key``, response, error. One client per partition; a call that fails, also after
    ``retries`` more tries with waits that double, only marks its row. Prompts are dealt out evenly to ``tasks`` (default: all cores), since a call costs far
    more than moving its prompt. ``in_flight`` calls run side by side in a task, so a client must bear that; with ``together`` the client takes a
    list of up to so many prompts and gives a list of responses.

    With ``answers``, a folder, answers are kept there: see :func:`ask_once`.
    """
    options = {"in_flight": in_flight, "retries": retries, "wait": wait, "together": together}
    if answers is not None:
        return ask_once(prompts, model, answers, key, tasks, **options)
    plain = prompts.select(F.col(key).cast("string").alias(key), "messages")
    plain = plain.repartition(tasks or prompts.sparkSession.sparkContext.defaultParallelism)
    return plain.mapInArrow(_caller(model, key, options), f"{key} string, response string, error string")


def _caller(model: ModelFactory, key: str, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model()
        for batch in batches:
            found = _answers(call, batch.column(1).to_pylist(), **options)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())],
                names=[key, "response", "error"],
            )

    return run


def _kept(spark, folder: str) -> DataFrame:
    """Answers kept in a folder: of each prompt one that has a response, else its last error."""
    try:
        rows = spark.read.schema(ANSWER).parquet(folder)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        rows = spark.createDataFrame([], ANSWER)
    best = F.max_by(F.struct("response", "error"), F.struct(F.col("response").isNotNull(), F.col("asked_at")))
    return rows.groupBy("prompt").agg(best.alias("a")).select("prompt", "a.*")


def ask_once(
    prompts: DataFrame, model: ModelFactory, folder: str, key: str = "question_id", tasks: int | None = None, *, per_task: int = PROMPTS_PER_TASK, **options,
) -> DataFrame:
    """As :func:`generate_responses`, with answers kept in ``folder`` by the hash of their prompt: equal prompts are asked once, and what
    was answered before, also by a run that was killed, is not asked again. Failed prompts are, by the next run.

    A task's answers are kept as soon as the task ends, not when the job does, and a task has ``per_task`` prompts at most: that is
    what a lost executor or a killed run may ask twice. One folder belongs to one model and its settings.
    """
    spark = prompts.sparkSession
    hashed = F.sha2(F.coalesce(F.to_json("messages"), F.lit("")), 256).alias("prompt")
    path = shared_folder(spark, "prompts")
    prompts.select(F.col(key).cast("string").alias(key), hashed, "messages").write.parquet(path)
    wanted = spark.read.parquet(path)
    known = _kept(spark, folder).filter("response IS NOT NULL").select("prompt")
    todo = wanted.groupBy("prompt").agg(F.first("messages").alias("messages")).join(known, "prompt", "left_anti")
    path = shared_folder(spark, "new-prompts")
    todo.write.parquet(path)
    todo = spark.read.schema(todo.schema).parquet(path)
    n = todo.count()
    if n:
        needed = max(min(n, tasks or spark.sparkContext.defaultParallelism), math.ceil(n / per_task))
        options = {"in_flight": 1, "retries": 0, "wait": 1.0, "together": 1} | options
        new = todo.repartition(needed).mapInArrow(_caller(model, "prompt", options), "prompt string, response string, error string")
        new = new.withColumn("asked_at", F.current_timestamp())
        new.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    found = _kept(spark, folder)
    few = found.count() <= FEW_ANSWERS
    return wanted.select(key, "prompt").join(F.broadcast(found) if few else found, "prompt").select(key, "response", "error")


def extracted(responses: DataFrame, mode: str = "last") -> DataFrame:
    """Responses with their SQL and whether it may run."""
    with_sql = responses.withColumn("sql", extract_sql(F.col("response"), mode))
    return with_sql.withColumn("is_valid", is_select(F.col("sql")))


def suggest_columns(questions: DataFrame, model: ModelFactory) -> DataFrame:
    """Columns a model suggests for every question, one per row."""
    ask = F.concat(F.lit(TEMPLATES["columns"]), F.col("question"))
    prompts = questions.select("question_id", F.array(message("user", ask)).alias("messages"))
    return suggestions(generate_responses(prompts, model).filter("response is not null"))


def questions_for_sql(df: DataFrame, model: ModelFactory, key: str = "id", sql: str = "sql", **calls) -> DataFrame:
    """A question for every statement that has none. ``calls``: options of :func:`generate_responses`."""
    prompts = task_prompt(df, "question", F.col(sql)).select(key, "messages")
    return generate_responses(prompts, model, key, **calls).withColumnRenamed("response", "question")


def split_intermediate(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final responses, and those that first ask for a look into the data."""
    wants = F.coalesce(F.contains("response", F.lit(INTERMEDIATE)), F.lit(False))
    return responses.filter(~wants), responses.filter(wants)


def two_step(
    context: DataFrame, model: ModelFactory, rebuild, previews, allow_data: bool = False, folder: str | None = None, **calls,
) -> DataFrame:
    """Responses after at most one look into the data: question_id, response, error.

    The first answers are written before they are split, so that no prompt is sent twice. ``previews`` turns the distinct intermediate statements (sql) into (sql, preview, error); ``rebuild``
    builds prompts from a context with one more documentation entry. ``calls``: options of :func:`generate_responses`.
    """
    spark = context.sparkSession
    path = f"{folder or shared_folder(spark, 'responses')}/first"
    generate_responses(rebuild(context), model, **calls).write.parquet(path)
    final, asking = split_intermediate(spark.read.parquet(path))
    if not allow_data:
        return final.unionByName(asking.withColumn("response", F.lit(NO_DATA_ACCESS)))
    wanted = asking.select("question_id", extract_sql(F.col("response")).alias("sql"))
    seen = wanted.join(previews(wanted.select("sql").distinct()), "sql", "left")
    failed = seen.filter("error is not null").select(
        "question_id", F.concat(F.lit("The look into the data failed: "), F.col("error")).alias("response"),
        F.lit(None).cast("string").alias("error"),
    )
    look = F.concat(F.lit("Result of the intermediate query "), F.col("sql"), F.lit(":\n"), F.col("preview"))
    entry = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("question"), look.alias("content"))
    richer = (
        context.join(seen.filter("error is null"), "question_id")
        .withColumn("documentation", F.concat("documentation", F.array(entry)))
        .select(*context.columns)
    )
    second = generate_responses(rebuild(richer), model, **calls)
    return final.unionByName(failed).unionByName(second)


def followup_lines(responses: DataFrame, n: int = 5) -> DataFrame:
    """Follow-up questions out of a response: numbers off, one per line, the first ``n``."""
    lines = F.slice(F.split(without_numbers(F.col("response")), "\n"), 1, n)
    return responses.select("question_id", F.posexplode(lines).alias("position", "followup"))


def _about(runs: DataFrame) -> Column:
    """What a model is told of a run (question, sql, preview)."""
    return F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\nSQL: "), F.col("sql"), F.lit("\nResult:\n"), F.col("preview")
    )


def followup_questions(runs: DataFrame, model: ModelFactory, n: int = 5, language: str | None = None) -> DataFrame:
    """Questions a model would ask next about runs (question_id, question, sql, preview), at most ``n`` each."""
    prompts = task_prompt(runs, "followup", _about(runs), language)
    return followup_lines(generate_responses(prompts, model).filter("response is not null"), n)


def summarize(runs: DataFrame, model: ModelFactory, language: str | None = None) -> DataFrame:
    """A model's summary of each run's result: question_id, summary, error."""
    prompts = task_prompt(runs, "summary", _about(runs), language)
    return generate_responses(prompts, model).withColumnRenamed("response", "summary")


def chart_code(runs: DataFrame, model: ModelFactory) -> DataFrame:
    """A model's plotting code for runs (question_id, question, sql, schema): question_id, code, error. The
    code is never run here; :func:`askwell.operators.profile.chart_spec` says what to draw."""
    about = F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\nSQL: "), F.col("sql"), F.lit("\nColumns of df:\n"), F.col("schema")
    )
    answered = generate_responses(task_prompt(runs, "chart", about), model)
    return answered.select("question_id", extract_code(F.col("response")).alias("code"), "error")


def rewrite_questions(turns: DataFrame, model: ModelFactory) -> DataFrame:
    """User turns (conv_id, turn, question) with the question asked for good: the first of a conversation as
    it is, later ones combined with the one before by the model."""
    made = rewrite_inputs(turns).withColumn("question_id", F.to_json(F.struct("conv_id", "turn")))
    ask = F.array(message("system", F.lit(TEMPLATES["rewrite"])), message("user", F.col("text")))
    answered = generate_responses(made.filter("needs_model").select("question_id", ask.alias("messages")), model)
    rewritten = F.when(F.col("needs_model"), F.col("response")).otherwise(F.col("question"))
    return made.join(answered, "question_id", "left").select(
        "conv_id", "turn", "question", rewritten.alias("rewritten"), "error"
    )


def fix_sql(runs: DataFrame, model: ModelFactory, mode: str = "last") -> DataFrame:
    """A model's correction of failed runs (question_id, question, sql, error, attempts): question_id,
    attempts, response, error, sql, is_valid."""
    failed = fix_inputs(runs).select(F.col("question_id").cast("string").alias("question_id"), "attempts", "messages")
    return failed.drop("messages").join(extracted(generate_responses(failed, model), mode), "question_id")


def clean_corpus(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (question, answer) as pairs with the SQL taken out of prose, and those without SQL."""
    found = answers.withColumn("sql", extract_sql(F.col("answer"))).withColumn("_ok", is_select(F.col("sql")))
    return found.filter("_ok").drop("_ok", "answer"), found.filter("not _ok").select("question", "answer")
