"""Relational patterns generated SQL uses that need care at scale: NOT IN, global ranks, exact percentiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.session import shared_folder

DIGIT = 16            # bits of a value that are counted at a time; divides 64
SMALL = 20_000        # rows of a bucket whose values are then counted
FEW_PLACES = 100_000  # wanted places that are broadcast, at most
SALTS = 16


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """SQL's NOT IN: nothing if ``values`` holds a null, else the rows without a match. A null in
    ``column`` only passes when there are no values at all."""
    facts = values.agg(
        F.count_if(F.col(value).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")
    )
    nulls, rows = facts.select("nulls").scalar(), facts.select("rows").scalar()
    listed = values.select(F.col(value).alias("_value")).distinct()  # a hot value counts once
    kept = df.join(listed, F.col(column) == F.col("_value"), "left_anti")
    return kept.filter((nulls == 0) & (F.col(column).isNotNull() | (rows == 0)))


def in_top(df: DataFrame, column: str, order: list[Column], n: int) -> DataFrame:
    """Rows whose ``column`` is among its ``n`` best groups; ``order`` ranks groups by ``column`` and ``n``."""
    best = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(n)
    return df.join(best.select(column), column, "left_semi")


def global_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` (a number) with its rank over all rows, one row per distinct value: ``value``, ``out``, n.

    Distinct values are counted and range-sorted, one range to a task; each range is ranked by itself on top of the row
    count of the ranges before. NaN is one value, larger than all others; nulls have no rank.
    """
    spark = df.sparkSession
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    path = shared_folder(spark, "ranks")  # written, since a range must be the same rows in both uses below
    counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(offsets, "_range").select(value, (F.col("_before") + F.col("_inside") + 1).alias(out), "n")


@F.pandas_udf(T.LongType())
def _bits(values: pd.Series) -> pd.Series:
    """Numbers whose unsigned order is that of the values; NaN is the largest, as in SQL."""
    bits = (values.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    bits = np.where(np.isnan(values.to_numpy(dtype=np.float64)), np.int64(0x7FF8 << 48), bits)
    return pd.Series(np.where(bits < 0, ~bits, bits | np.int64(-(2**63))))


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles (SQL's PERCENTILE_CONT) of ``value`` per key, one column per fraction. Nulls do not count; a
    null key is a key.

    Selection by radix: rows are counted by key and by the leading ``DIGIT`` bits of the value's order-preserving form. The
    bucket that holds a wanted place is counted again by the next bits, until no such bucket has more than ``SMALL`` rows, or
    its bits are all given; then the bucket's distinct values are counted. Counts combine on the map side, and a task
    gets at most 2 ** ``DIGIT`` counts for each wanted place of a key, however many rows the key has.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").withColumn("_u", _bits("_v"))
    key_fields = [df.schema[k] for k in keys]
    state_type = T.StructType([*key_fields, *T.StructType.fromDDL("_name string, _side int, _part double, _prefix bigint, _rest bigint, _size bigint").fields])

    def stored(state: DataFrame) -> DataFrame:
        path = shared_folder(spark, "places")
        state.write.parquet(path)
        return spark.read.schema(state_type).parquet(path)

    def first(counts: pa.Table) -> pa.Table:
        digits, n = _in_order(counts, "_digit")
        places = [(name, f * (int(n.sum()) - 1)) for name, f in fractions.items()]
        wanted = [(name, side, place - math.floor(place), (math.floor, math.ceil)[side](place)) for name, place in places for side in (0, 1)]
        return _picked(counts, keys, wanted, digits, n)

    def further(state: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for prefix, wanted in _by_prefix(state):
            digits, n = _in_order(counts.filter(pc.equal(counts["_prefix"], prefix)), "_digit")
            out.append(_picked(state, keys, wanted, (np.int64(prefix) << np.int64(DIGIT)) | digits, n))
        return pa.concat_tables(out)

    def values(state: pa.Table, counts: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for prefix, wanted in _by_prefix(state):
            v, n = _in_order(counts.filter(pc.equal(counts["_prefix"], prefix)), "_v")
            for (name, side, part, rest), i in zip(wanted, np.searchsorted(np.cumsum(n), [w[3] for w in wanted], side="right")):
                found.setdefault(name, [part, None, None])[1 + side] = float(v[i])
        columns = {name: pa.array([x + (y - x) * part if part else x]) for name, (part, x, y) in found.items()}
        return pa.table({k: state[k].slice(0, 1) for k in keys} | columns)

    counts = rows.groupBy(*keys, F.shiftrightunsigned("_u", 64 - DIGIT).alias("_digit")).agg(F.count(F.lit(1)).alias("_c"))
    state = stored(counts.groupBy(*(keys or [F.lit("all")])).applyInArrow(first, state_type))
    given = DIGIT
    while given < 64 and (state.agg(F.max("_size")).first()[0] or 0) > SMALL:
        inside = _inside(rows, state, keys, given)
        digit = F.shiftrightunsigned("_u", 64 - given - DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = inside.groupBy(*keys, "_prefix", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_c"))
        state = stored(_meeting(state, counts, keys, further, state_type))
        given += DIGIT
    counts = _inside(rows, state, keys, given).groupBy(*keys, "_prefix", "_v").agg(F.count(F.lit(1)).alias("_c"))
    result = T.StructType([*key_fields, *[T.StructField(name, T.DoubleType()) for name in fractions]])
    found = _meeting(state, counts, keys, values, result)
    return found if keys else found.agg(*[F.max(name).alias(name) for name in fractions])  # one row of nulls if there are none


def _in_order(counts: pa.Table, by: str) -> tuple[np.ndarray, np.ndarray]:
    x, n = counts[by].to_numpy(), counts["_c"].to_numpy()
    order = np.argsort(x, kind="stable")
    return x[order], n[order]


def _by_prefix(state: pa.Table):
    """The wanted places (name, side, part, rank) of each bucket."""
    groups: dict[int, list] = {}
    for name, side, part, prefix, rest in zip(*(state[c].to_pylist() for c in ("_name", "_side", "_part", "_prefix", "_rest"))):
        groups.setdefault(prefix, []).append((name, side, part, rest))
    return groups.items()


def _picked(table: pa.Table, keys: list[str], wanted: list[tuple], prefixes: np.ndarray, n: np.ndarray) -> pa.Table:
    """The bucket that holds each wanted place, and the place within it."""
    upto = np.cumsum(n)
    at = np.searchsorted(upto, [w[3] for w in wanted], side="right")
    repeated = pa.array(np.zeros(len(wanted), dtype=np.int64))
    return pa.table({k: table[k].combine_chunks().take(repeated) for k in keys} | {
        "_name": [w[0] for w in wanted], "_side": pa.array([w[1] for w in wanted], pa.int32()), "_part": [w[2] for w in wanted],
        "_prefix": pa.array(prefixes[at], pa.int64()), "_rest": pa.array(np.array([w[3] for w in wanted]) - (upto[at] - n[at]), pa.int64()), "_size": pa.array(n[at], pa.int64())})


def _meeting(state: DataFrame, counts: DataFrame, keys: list[str], pick, kind: T.StructType) -> DataFrame:
    """``pick`` of each key's places and counts."""
    by = keys or [F.lit("all")]
    counts = counts.select([F.col(c).alias(c) for c in counts.columns])  # apart from the columns of the other side
    return state.groupBy(*by).cogroup(counts.groupBy(*by)).applyInArrow(pick, kind)


def _inside(rows: DataFrame, state: DataFrame, keys: list[str], given: int) -> DataFrame:
    """Rows of the buckets that hold a wanted place. Few buckets, counted first, are broadcast and the rows stay where they are; of many
    buckets each has a row for every salt, and rows are salted by where they lie."""
    buckets = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_prefix").distinct()
    few = state.count() <= FEW_PLACES
    if few:
        buckets = F.broadcast(buckets)
    else:
        buckets = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = F.shiftrightunsigned("_u", 64 - given) == F.col("_prefix") if given < 64 else F.col("_u") == F.col("_prefix")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if not few:
        rows = rows.withColumn("_place", F.spark_partition_id() % SALTS)
        match = match & (F.col("_place") == F.col("_salt"))
    return rows.join(buckets, match).drop(*[f"_k{i}" for i in range(len(keys))], "_salt", "_place")
