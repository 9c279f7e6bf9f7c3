"""Helpers shared by the operators: tables written below the shared folder, batches of bounded bytes, word codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.session import shared_folder

#: Fixed by the contracts: a word is a run of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

BATCH_BYTES = 1 << 20


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: its lineage ends here, and a lost executor costs
    a read, not a second run of what came before."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranges(spark, rows: int, each: int) -> int:
    """How many ranges ``rows`` rows are dealt into, so that a task has ``each`` at most, about."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key. A key may hold any part of ``left``: keys with more
    than 1 / ``share`` of its rows are fewer than ``share``, and their rows of ``right`` are broadcast; the others are
    shuffled. ``left`` is read three times, so it should be a written table."""
    most = max(left.count() / share, 1000)
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key")).filter(F.col("rows_of_key") > most).select(*on)
    hot = written(hot, "hot-keys")
    in_hot = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    return in_hot.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))


def held_out(doc_id: Column | str) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def cut(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of a text column of about ``most`` bytes each, one row at least."""
    if not len(column):
        return
    texts = column.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def each_slice(work, columns: Iterator[pa.Array], kind: pa.DataType) -> Iterator[pa.Array]:
    """``work`` turns a list of texts (null: None) into an Arrow array; one array per incoming batch goes out."""
    for column in columns:
        parts = [work(part.to_pylist()) for part in cut(column)]
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)


class Codes(dict):
    """Numbers for strings, given in order of appearance; ``new`` holds those not yet taken by ``fresh``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = len(self)
        self[word] = code
        self.new.append(word)
        return code

    def fresh(self) -> list[str]:
        new, self.new = self.new, []
        return new


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
