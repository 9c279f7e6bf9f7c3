"""Learning from a stream of runs, and counting outcomes over time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from askwell.operators.embedding import ModelFactory
from askwell.operators.run import auto_train
from askwell.operators.training import learn
from askwell.sources.store import CorpusStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000
REMEMBER_DAYS = 365.0


class FirstOfKey(StatefulProcessor):
    """The first row of a key, once. A key that was sent is remembered for ``remember_ms`` (None: always)."""

    def __init__(self, remember_ms: int | None):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "sent boolean", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows, None)
        if first is not None and not self.sent.exists():
            self.sent.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of an id within one partition of a micro-batch end here, so that a pair that is asked all the time comes to its
    key's task as one row for each partition."""
    seen: set[str] = set()
    for batch in batches:
        ids = batch.column("id").to_pylist()
        new = [x not in seen and not seen.add(x) for x in ids]
        yield batch.filter(pa.array(new, pa.bool_()))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs this store; it keeps on disk what memory does not hold, and writes changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_once(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query that ends when it has worked off what is there. State that expires by the clock would keep such a query
    busy with empty micro-batches for good, so it starts without them; the session's other streams keep theirs."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()  # takes the settings of this moment
    finally:
        spark.conf.set(name, before)


def training_stream(runs: DataFrame, remember_days: float | None = REMEMBER_DAYS) -> DataFrame:
    """Pairs that gave rows, each sent out once: over micro-batches, over restarts from the same checkpoint, and however
    late a repeat comes. State is one flag for each id, for ``remember_days`` after it was sent, by the clock."""
    keep_state_in_rocksdb(runs.sparkSession)
    rows = auto_train(runs.withColumn("created_at", F.col("ts").cast("timestamp")))
    once = rows.mapInArrow(first_of_partition, rows.schema)
    remember = None if remember_days is None else max(1, int(remember_days * DAY_MS))
    return once.groupBy("id").transformWithState(FirstOfKey(remember), rows.schema, outputMode="Append", timeMode="ProcessingTime")


def start_auto_train(runs: DataFrame, store: CorpusStore, checkpoint: str, remember_days: float | None = REMEMBER_DAYS, once: bool = True, embedder: ModelFactory | None = None) -> StreamingQuery:
    """Adds successful runs of a stream to ``store``, with vectors if it keeps them; a replayed batch adds nothing twice."""
    def add(batch: DataFrame, epoch: int) -> None:
        learn(store, batch, embedder)

    writer = training_stream(runs, remember_days).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return start_once(runs.sparkSession, writer) if once else writer.start()


def outcome_windows(runs: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Runs (ts, category) counted per window and category; on a stream, late rows past ``delay`` are dropped."""
    timed = runs.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "category", "n")
