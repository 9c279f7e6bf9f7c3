"""Top-k per key, ordered text per key and a checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1.

    With a constant ``k`` Catalyst cuts every map task's rows to ``k`` per key before the shuffle, so a
    hot key never brings more than tasks x k rows to one reducer.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """One row per key, the one with the greatest ``by``; combined on the map side, so no key is sorted whole.

    A row without ``by`` comes before all others; equal ones are told apart by a hash of the row, so the same rows
    always give the same one.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.struct(by.isNotNull(), by, F.xxhash64(*others))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in others])


def joined_text(
    df: DataFrame, keys: list[str], position: str, line: str, separator: str, out: str, segment: int = 256
) -> DataFrame:
    """Lines of every key joined in order of ``position`` (a number, ties by the line itself).

    Two steps: stretches of ``segment`` positions are joined first, spread over the cluster, then the
    stretches of a key. A key with very many lines thus never sorts its single lines in one task.
    """
    def ordered(rank_col: str, text_col: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(rank_col), F.col(text_col))))
        return F.array_join(F.transform(pairs, lambda p: p[text_col]), separator)

    stretch = F.floor(F.col(position) / F.lit(float(segment)))
    pieces = (
        df.select(*keys, F.col(position).alias("_pos"), F.col(line).alias("_line"), stretch.alias("_stretch"))
        .groupBy(*keys, "_stretch").agg(ordered("_pos", "_line").alias("_piece"))
    )
    return pieces.groupBy(*keys).agg(ordered("_stretch", "_piece").alias(out))


def previous(df: DataFrame, key: str, position: str, value: str, out: str, stretch: int = 1024) -> DataFrame:
    """``df`` with the ``value`` of the row before, by ``position`` (a number, unique within ``key``).

    Rows are looked at in stretches of positions; only one row per stretch, its last, is ordered within
    the whole key, so a key with very many rows is not sorted in one task.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(position) / F.lit(float(stretch))))
    inner = Window.partitionBy(key, "_stretch").orderBy(position)
    # wrapped in a struct, so that a null value before is told from no row before
    here = cut.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    ends = cut.groupBy(key, "_stretch").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(position)).alias("_end"))
    carried = ends.select(key, "_stretch", F.lag("_end").over(Window.partitionBy(key).orderBy("_stretch")).alias("_carried"))
    joined = here.join(carried, [key, "_stretch"], "left")
    return joined.withColumn(out, F.coalesce("_before", "_carried")["v"]).select(*df.columns, out)


def spread(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A table of few rows over all cores, for heavy work per row; a large one stays as it lies.

    Counting a stored table reads file footers only, and a large table has splits enough.
    """
    if df.count() > most_rows:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def bounded_rows(df: DataFrame, limit: int):
    """``df`` as an Arrow table if it has at most ``limit`` rows, else None. At most ``limit`` + 1 rows
    reach the driver."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None
