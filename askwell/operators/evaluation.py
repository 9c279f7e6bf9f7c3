"""Scoring: accuracy by model and strategy, comparing results, context strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGIES = ("schema", "static", "retrieved")


def accuracy_cube(trials: DataFrame) -> DataFrame:
    """Trials (model, strategy, correct) by model and strategy, by each alone, and overall."""
    return trials.cube("model", "strategy").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("trials"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
    )


def _comparable(df: DataFrame, digits: int) -> DataFrame:
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    cols = [
        (F.round(F.col(f"`{f.name}`").cast("double"), digits) if isinstance(f.dataType, fractional) else F.col(f"`{f.name}`"))
        .alias(f"c{i}")
        for i, f in enumerate(df.schema)
    ]
    return df.select(*cols)


def result_diff(got: DataFrame, expected: DataFrame, digits: int = 6) -> DataFrame:
    """Rows only one side has: side, the columns by position (c0, c1, ...), and how many more.

    One grouping over both sides; equal rows cancel out.
    """
    if len(got.columns) != len(expected.columns):
        raise ValueError(f"{len(got.columns)} columns against {len(expected.columns)}")
    left = _comparable(got, digits).withColumn("_n", F.lit(1))
    right = _comparable(expected, digits).withColumn("_n", F.lit(-1))
    columns = [c for c in left.columns if c != "_n"]
    surplus = left.unionByName(right).groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return surplus.select(F.when(F.col("_n") > 0, "got").otherwise("expected").alias("side"), *columns, F.abs("_n").alias("n"))


def same_row_count(got: DataFrame, expected: int) -> DataFrame:
    return got.agg(F.count(F.lit(1)).alias("row_count")).withColumn("passed", F.col("row_count") == expected)


def context_strategies(context: DataFrame, static_pairs: list[tuple[str, str]]) -> DataFrame:
    """Each retrieved context three times: tables only, tables and fixed examples, and as retrieved."""
    pair = "array<struct<id:string,question:string,content:string>>"
    none = F.expr(f"cast(array() as {pair})")
    fixed = F.array(*[
        F.struct(F.lit(None).cast("string").alias("id"), F.lit(q).alias("question"), F.lit(s).alias("content"))
        for q, s in static_pairs
    ]) if static_pairs else none
    crossed = context.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    return crossed.withColumns({
        "pairs": F.when(F.col("strategy") == "schema", none).when(F.col("strategy") == "static", fixed).otherwise(F.col("pairs")),
        "documentation": F.when(F.col("strategy") == "retrieved", F.col("documentation")).otherwise(none),
    })
