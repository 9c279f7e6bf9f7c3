"""BM25 from an inverted index: postings written once, by term and range of rows, with the largest impact of each block.

Rows are numbered by id and cut into ranges of ``RANGE`` rows. A block holds the postings of one term in one range, so a word
that every text has is split over all ranges. A search reads blocks of asked terms only. It first looks at the largest impacts
alone: each range has a row that reaches one term's largest impact, so the k-th best of these is reached by k rows,
and ranges whose largest impacts together stay below it are skipped. What is left is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwell.functions.text import words
from askwell.operators.keyword import B, DIGITS, K1, POSTING_ENTRIES
from askwell.operators.ranking import bounded_rows, top_k
from askwell.session import shared_folder

RANGE = 2048            # rows of a range
RANGES_PER_TASK = 32    # at building
QUESTIONS = 1000        # questions scored together
FEW_ASKED = 100_000     # (question, term) rows that are broadcast, at most
FEW_TERMS = 200         # asked terms that are pushed down to the scan, at most
SLACK = 1e-5            # more than what rounding does to a score


@dataclass(frozen=True)
class KeywordIndex:
    """Three tables in a folder: ``rows`` (range, place, id, training_data_type, words), ``blocks`` (term, range, largest, places,
    impacts) and ``terms`` (term, texts)."""

    spark: SparkSession
    folder: str
    count: int
    ranges: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


# numbers of a term's rows as bytes (int32), which Spark moves as they are, and not one by one
POSTINGS = "term string, range bigint, places binary, counts binary, words binary, ids array<string>, kinds array<string>, lengths array<int>"


def _as_bytes(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as binary values."""
    offsets = np.r_[starts, len(values)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of binary values end to end, and how many each has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind), pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize


def _postings(tokens: DataFrame, size: int) -> DataFrame:
    """Term, range, places, counts and words of the rows, from rows in order of their ids (id, training_data_type, tokens); and for each range a row
    without a term that has the ids and kinds of its rows. A task numbers its own ranges, so a range may be short."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                held.append(batch.slice(start, size))
                n += held[-1].num_rows
                while n >= size:
                    table = pa.Table.from_batches(held)
                    yield from blocks(number, table.slice(0, size))
                    held, n, number = table.slice(size).to_batches(), n - size, number + 1
        if n:
            yield from blocks(number, pa.Table.from_batches(held))

    def blocks(number: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        tokens = pa.concat_arrays(part["tokens"].chunks)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        whole = lambda x, kind: pa.array([x], pa.list_(kind))
        ids, kinds = (part[c].cast(pa.string()).to_pylist() for c in ("id", "training_data_type"))
        no_bytes = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array([None], pa.string()), pa.array([number]), no_bytes, no_bytes, no_bytes, whole(ids, pa.string()), whole(kinds, pa.string()),
            whole(lengths, pa.int32())], names=names)
        flat = tokens.flatten().dictionary_encode()
        place = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        key, count = np.unique((flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | place, return_counts=True)
        term, place = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        if not len(term):
            return
        starts = np.flatnonzero(np.r_[True, np.diff(term) != 0])
        none = pa.nulls(len(starts), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([
            flat.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), number)), _as_bytes(place, starts),
            _as_bytes(count.astype(np.int32), starts), _as_bytes(lengths[place], starts), none, none, none.cast(pa.list_(pa.int32()))], names=names)

    names = ["term", "range", "places", "counts", "words", "ids", "kinds", "lengths"]
    return tokens.mapInArrow(run, POSTINGS)


def _impacts(postings: DataFrame, mean: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (place, sizes), (count, _), (n, _) = (_numbers(batch.column(x), np.int32) for x in ("places", "counts", "words"))
            impact = count * (K1 + 1.0) / (count + K1 * ((1.0 - B) + B * n / mean))
            starts = np.cumsum(sizes) - sizes
            places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(place)], pa.int32()), pa.array(place))
            yield pa.RecordBatch.from_arrays([
                batch.column("term"), batch.column("range"), pa.array(np.maximum.reduceat(impact, starts)), places, _as_bytes(impact, starts)],
                names=["term", "range", "largest", "places", "impacts"])

    return postings.mapInArrow(run, "term string, range bigint, largest double, places array<int>, impacts binary")


def build_index(corpus: DataFrame, text_col: str = "content", folder: str | None = None, range_rows: int = RANGE) -> KeywordIndex:
    """Writes the index of ``corpus`` (id, training_data_type, text), which must have an id in each row, each once. A null text has
    no words. Without ``folder`` it goes below the shared folder and lasts as long as the application."""
    spark = corpus.sparkSession
    folder = folder or shared_folder(spark, "keyword-index")
    count = corpus.count()
    tasks = max(math.ceil(count / (range_rows * RANGES_PER_TASK)), min(spark.sparkContext.defaultParallelism, math.ceil(count / range_rows)), 1)
    # the number of tasks is given, so that numbers are by id over all of them; texts are moved, which are smaller than their words, and the sample
    # that the ranges of ids are cut by needs no words
    ordered = corpus.select("id", "training_data_type", F.col(text_col).alias("_text")).repartitionByRange(tasks, "id").sortWithinPartitions("id")
    tokens = ordered.select("id", "training_data_type", F.coalesce(words(F.col("_text")), F.array().cast("array<string>")).alias("tokens"))
    raw = shared_folder(spark, "keyword-postings")
    _postings(tokens, range_rows).write.parquet(raw)
    postings = spark.read.schema(POSTINGS).parquet(raw)
    rows = postings.filter("term IS NULL").select("range", F.posexplode(F.arrays_zip("ids", "kinds", "lengths")).alias("place", "r"))
    rows.select("range", "place", F.col("r.ids").alias("id"), F.col("r.kinds").alias("training_data_type"), F.col("r.lengths").alias("words")).write.parquet(f"{folder}/rows")
    n, mean, ranges = spark.read.parquet(f"{folder}/rows").agg(F.count(F.lit(1)), F.avg("words"), F.count_distinct("range")).first()
    blocks = _impacts(postings.filter("term IS NOT NULL").select("term", "range", "places", "counts", "words"), mean or 1.0)
    impacts = shared_folder(spark, "keyword-impacts")
    blocks.write.parquet(impacts)  # read twice: for a sample of the terms, and to be dealt out by them
    blocks = spark.read.schema(blocks.schema).parquet(impacts)
    blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.parquet(f"{folder}/blocks")
    index = KeywordIndex(spark, folder, n, ranges)
    index.table("blocks").groupBy("term").agg(F.sum(F.size("places")).alias("texts")).write.parquet(f"{folder}/terms")
    return index


def _scored(k: int):
    """Scores of a range's rows for a block of questions; the k best of each question, and those that tie with the last."""
    names = ["question_id", "range", "place", "score"]

    def run(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        questions = asked["question_id"].combine_chunks().dictionary_encode()
        terms = blocks["term"].combine_chunks()
        block_of = pc.index_in(asked["term"].combine_chunks(), terms)
        known = block_of.is_valid().to_numpy(zero_copy_only=False)
        block_of = pc.fill_null(block_of, 0).to_numpy(zero_copy_only=False)[known]
        asker = questions.indices.to_numpy(zero_copy_only=False)[known].astype(np.int64)
        weight = asked["weight"].to_numpy()[known]
        lists = blocks["places"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        place, impact = lists.flatten().to_numpy(), _numbers(blocks["impacts"], np.float64)[0]
        width = int(place.max(initial=-1)) + 1
        n = len(questions.dictionary)
        total = np.zeros(n * width)
        fan = sizes[block_of]
        ends, start = np.cumsum(fan), 0
        while start < len(fan):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + POSTING_ENTRIES, side="right")))
            each = fan[start:stop]
            at = np.arange(int(each.sum())) + np.repeat(first[block_of[start:stop]] - (np.cumsum(each) - each), each)
            total += np.bincount(np.repeat(asker[start:stop] * width, each) + place[at], weights=np.repeat(weight[start:stop], each) * impact[at], minlength=len(total))
            start = stop
        scores = np.round(total, DIGITS).reshape(n, width)
        near = total.reshape(n, width) > 0
        if k < width:
            near &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(near)
        return pa.table([questions.dictionary.take(pa.array(q)), pa.array(np.full(len(q), key[0].as_py())), pa.array(r, pa.int32()), pa.array(scores[q, r])], names=names)

    return run


def search_index(index: KeywordIndex, questions: DataFrame, k: int = 10, question_col: str = "question") -> DataFrame:
    """As :func:`askwell.operators.keyword.bm25`: the ``k`` best texts of every question that share a word with it:
    question_id, training_data_type, id, score, rank. Ties go to the smaller id."""
    blocks, spark = index.table("blocks"), index.spark
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), F.explode(F.array_distinct(words(F.col(question_col)))).alias("term"))
    n = F.lit(float(index.count))
    weight = F.log(1.0 + (n - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    asked = asked.join(index.table("terms"), "term").select("question_id", "term", weight.alias("weight"))
    few = bounded_rows(asked, FEW_ASKED)
    if few is None:
        path = shared_folder(spark, "asked-terms")
        asked.write.parquet(path)
        asked, together = spark.read.parquet(path), math.ceil(questions.count() / QUESTIONS)
    else:
        asked, together = F.broadcast(spark.createDataFrame(few)), math.ceil(len(few["question_id"].unique()) / QUESTIONS)
        terms = few["term"].unique().to_pylist()
        if len(terms) <= FEW_TERMS:
            blocks = blocks.filter(F.col("term").isin(terms))
    asked = asked.withColumn("together", F.pmod(F.xxhash64("question_id"), F.lit(max(together, 1))))

    left = asked.join(blocks.select("term", "range", "largest"), "term")
    needed = asked.select("together", "term").distinct()
    if index.ranges > k:  # else no range can be skipped
        reach = F.col("weight") * F.col("largest")
        bounds = left.groupBy("question_id", "range").agg(F.sum(reach).alias("most"), F.max(reach).alias("reached"))
        kth = bounds.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("reached")))).filter(F.col("n") == k)
        reached = bounds.join(kth.select("question_id", F.col("reached").alias("least")), "question_id", "left")
        reached = reached.filter(F.col("most") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("question_id", "range")
        path = shared_folder(spark, "asked-ranges")
        left.join(reached, ["question_id", "range"]).write.parquet(path)
        left, needed = spark.read.parquet(path), spark.read.parquet(path).select("together", "range", "term").distinct()
    on = [x for x in ("range", "term") if x in needed.columns]
    right = blocks.select("term", "range", "places", "impacts").join(F.broadcast(needed) if few is not None and on == ["term"] else needed, on)
    left = left.select("question_id", "term", "weight", "range", "together")
    right = right.select([F.col(x).alias(x) for x in right.columns])  # apart from the left side's columns
    found = left.groupBy("range", "together").cogroup(right.groupBy("range", "together")).applyInArrow(
        _scored(k), "question_id string, range bigint, place int, score double")
    best = top_k(found, ["question_id"], [F.desc("score"), F.col("range"), F.col("place")], k)
    hits = best.join(index.table("rows").drop("words"), ["range", "place"])
    return hits.select("question_id", "training_data_type", "id", "score", "rank")
