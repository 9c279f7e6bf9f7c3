"""What a result looks like: preview, schema, chart, nulls; counts by outcome and log read-outs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.operators.bootstrap import markdown_header, markdown_line
from askwell.schemas import NO_SQL_GENERATED, SQL_RAN, SQL_UNABLE_TO_RUN

PREVIEW_ROWS = 10    # fixed value
FOLLOWUP_ROWS = 25   # fixed value
PIE_VALUES = 10      # fixed value


def preview_json(df: DataFrame, keys: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by ``keys`` as JSON records with ISO dates."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
               "ignoreNullFields": "false"}
    return df.orderBy(*keys).limit(n).select(F.to_json(F.struct(*df.columns), options).alias("record"))


def markdown(df: DataFrame, keys: list[str], n: int | None = FOLLOWUP_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``keys`` as one markdown text of ``columns`` (all by default). A text is one value, so
    ``n`` is None only for results known to be small."""
    rows = df if n is None else df.orderBy(*keys).limit(n)
    columns = columns or df.columns
    line = F.struct(*keys, markdown_line([F.col(c) for c in columns]).alias("_line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["_line"]), "\n")
    return rows.agg(F.concat(F.lit(markdown_header(columns)), text).alias("markdown"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def should_chart(df: DataFrame) -> DataFrame:
    """Whether a chart makes sense: more than one row and a numeric column. Looks at two rows."""
    numeric = bool(numeric_columns(df))
    return df.limit(2).agg(((F.count(F.lit(1)) > 1) & F.lit(numeric)).alias("should_chart"))


def some_distinct(df: DataFrame, column: str, n: int) -> DataFrame:
    """Distinct values of a text column, all of them if there are fewer than ``n``, else at least ``n``.

    Every task stops reading at its ``n``-th value, so a column of many values is not shuffled to find out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            seen.update(v for v in pc.unique(batch.column(0)).to_pylist()[: n + 1] if v is not None)
            if len(seen) >= n:
                break
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen)[:n], pa.string())], names=["value"])

    return df.select(column).mapInArrow(run, "value string").distinct()


def chart_spec(df: DataFrame) -> DataFrame:
    """Kind of chart and its columns: one row kind, x, y."""
    numbers, texts = numeric_columns(df), text_columns(df)

    def spec(kind: Column, x: Column, y: Column) -> list[Column]:
        return [kind.alias("kind"), x.cast("string").alias("x"), y.cast("string").alias("y")]

    one = df.limit(1).agg(F.count(F.lit(1)).alias("_rows"))
    if len(numbers) >= 2:
        return one.select(*spec(F.lit("scatter"), F.lit(numbers[0]), F.lit(numbers[1])))
    if numbers and texts:
        return one.select(*spec(F.lit("bar"), F.lit(texts[0]), F.lit(numbers[0])))
    if texts:
        few = F.count(F.lit(1)) < PIE_VALUES
        pie = some_distinct(df, texts[0], PIE_VALUES).agg(few.alias("few"))
        return pie.select(*spec(F.when(F.col("few"), "pie").otherwise("line"), F.when(F.col("few"), texts[0]), F.lit(None)))
    return one.select(*spec(F.lit("line"), F.lit(None), F.lit(None)))


def schema_text(df: DataFrame) -> str:
    """Names and types of a result, one per line."""
    return "\n".join(f"{name} {kind}" for name, kind in df.dtypes)


def null_profile(df: DataFrame) -> DataFrame:
    """Share of nulls per column in percent, in one pass."""
    total = F.count(F.lit(1))
    shares = [
        F.struct(F.lit(c).alias("column_name"), F.round(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, total), 2).alias("null_pct"))
        for c in df.columns
    ]
    return df.agg(F.array(*shares).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def outcome(sql: Column, error: Column) -> Column:
    """Outcome category of a run."""
    return (
        F.when(sql.isNull() | (sql == ""), NO_SQL_GENERATED).when(error.isNotNull(), SQL_UNABLE_TO_RUN).otherwise(SQL_RAN)
    )


def accuracy_stats(runs: DataFrame) -> DataFrame:
    """Number of questions and how many per category."""
    counts = runs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("num_questions"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("data"),
    )


def latest_fields(log: DataFrame, fields: list[str]) -> DataFrame:
    """A log (id, field, value, ts) as one row per id with the newest value of each field.

    All ids and fields are combined on the map side in one grouping.
    """
    newest = [
        F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("ts", "seq"))).alias(f)
        for f in fields
    ]
    return log.groupBy("id").agg(*newest)


def question_history(log: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """Latest fields of every id; ``missing`` names the required ones it lacks."""
    wide = latest_fields(log, fields)
    gaps = F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in required])
    return wide.withColumn("missing", gaps)


def elapsed(log: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds between first and last entry of each key."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return log.groupBy(*keys).agg(
        F.round((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6, 3).alias("seconds")
    )


def run_template(spark: SparkSession, template: dict, values: dict) -> DataFrame:
    """A parameterised query: name, sql with ``:name`` markers, arguments (name, type, available).

    Values are checked against what is available and bound by Spark, never pasted into the text.
    """
    bound = {}
    for arg in template["arguments"]:
        name = arg["name"]
        if name not in values:
            raise ValueError(f"{template['name']}: no value for {name}")
        value = values[name]
        if arg.get("available") and value not in arg["available"]:
            raise ValueError(f"{template['name']}: {value!r} is not available for {name}")
        bound[name] = {"number": float, "integer": int, "string": str}.get(arg.get("type", "string"), str)(value)
    unknown = set(values) - set(bound)
    if unknown:
        raise ValueError(f"{template['name']}: unknown arguments {sorted(unknown)}")
    return spark.sql(template["sql"], args=bound)
