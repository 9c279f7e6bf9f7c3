"""The corpus on disk: a Parquet table that Spark buckets by id.

Each bucket is a partition of its own, so adding rows compares ids bucket by bucket without moving what is stored, and a change
reads and writes the buckets of the changed ids only. Writes are Spark's own: an append adds files when its job commits,
a change replaces the partitions it wrote (dynamic partition overwrite). Two appends at a time may both add an id; readers
see one row of it, and compaction leaves one. Changes are for one writer at a time.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.operators.corpus import merge, one_per_id, remove, remove_kind, update
from askwell.operators.embedding import ModelFactory, embed

BUCKETS = 16
MODE = "spark.sql.sources.partitionOverwriteMode"


class CorpusStore:
    """A corpus below ``path``, a folder every executor can reach. ``buckets`` belongs to the stored files, as ``schema`` does: it
    must be the same whenever the store is opened. Some 100 MB of text to a bucket are a good size."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.name = "corpus_" + hashlib.sha256(f"{self.path} {buckets} {schema.simpleString()}".encode()).hexdigest()[:24]

    def _bucket(self, id_col: str | Column = "id") -> Column:
        """The bucket Spark puts an id in."""
        return F.pmod(F.hash(id_col), F.lit(self.buckets))

    def _table(self) -> DataFrame:
        """All stored rows as they lie, with their bucket, from the table's description in this application's catalog."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(folder)
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema.toDDL()}, bucket INT) USING parquet PARTITIONED BY (bucket) "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")  # also those that other applications wrote
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).filter("id IS NOT NULL")

    def read(self) -> DataFrame:
        """One row of each id. Rows of an id lie together, so nothing is moved for that."""
        return one_per_id(self._table().select(*self.schema.names))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows one per id, dealt out as the buckets are."""
        return one_per_id(rows.select(*self.schema.names).repartition(self.buckets, "id"))

    def new_rows(self, rows: DataFrame) -> DataFrame:
        """Rows whose id is not stored yet, one per id. The stored side is read where it lies, its id column only."""
        stored = self._table().select("id").hint("merge")
        return self._dealt(rows).join(stored, "id", "left_anti").select(*self.schema.names)

    def append_new(self, rows: DataFrame) -> None:
        """Adds rows whose id is not stored yet. Doing it twice adds nothing."""
        self.new_rows(rows).withColumn("bucket", self._bucket()).write.insertInto(self.name)

    @contextmanager
    def _replacing(self):
        """Only partitions that are written are replaced."""
        before = self.spark.conf.get(MODE)
        self.spark.conf.set(MODE, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(MODE, before)

    def _rewrite(self, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` in place of what these buckets hold. Each gets a row without an id, so that an emptied one is written too."""
        rows = self._dealt(rows).withColumn("bucket", self._bucket())
        blank = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        blank = blank.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "bucket")
        with self._replacing():
            rows.unionByName(blank).write.insertInto(self.name, overwrite=True)

    def _touched(self, ids: DataFrame) -> list[int]:
        """The buckets of some ids, of which there are ``buckets`` at most."""
        return sorted(r[0] for r in ids.filter("id IS NOT NULL").select(self._bucket()).distinct().collect())

    def _change(self, ids: DataFrame, change) -> None:
        """``change`` of the stored rows in the buckets of ``ids``."""
        buckets = self._touched(ids)
        if buckets:
            self._rewrite(change(self._held(buckets)), buckets)

    def _held(self, buckets: list[int]) -> DataFrame:
        return one_per_id(self._table().filter(F.col("bucket").isin(buckets)).select(*self.schema.names))

    def replace(self, rows: DataFrame) -> None:
        """The whole corpus anew."""
        self._table()
        self._rewrite(rows, list(range(self.buckets)))

    def compact(self) -> None:
        """Many small files as one for each bucket."""
        self.replace(self.read())

    def upsert(self, rows: DataFrame) -> None:
        self._change(rows, lambda held: merge(held, rows.select(*self.schema.names), "upsert"))

    def remove(self, ids: DataFrame) -> None:
        """Without the rows of these ids."""
        self._change(ids, lambda held: remove(held, ids))

    def remove_kind(self, kind: str) -> None:
        """With one collection emptied."""
        remove_kind(self.read(), kind)  # refuses an unknown kind
        self._change(self._table().filter(F.col("training_data_type") == kind), lambda held: remove_kind(held, kind))

    def update(self, changes: DataFrame, embedder: ModelFactory | None = None) -> None:
        """Field by field, see :func:`askwell.operators.corpus.update`. Changed texts, and those in the same buckets that lack a vector,
        get theirs in the same job, if the store keeps vectors."""
        def changed(held: DataFrame) -> DataFrame:
            rows = update(held, changes)
            if "embedding" in held.columns:
                lacking = F.col("needs_embedding") | F.col("embedding").isNull()
                rows = embed(rows.withColumn("_text", F.when(lacking, F.col("embed_text"))), "_text", embedder, out="_made")
                rows = rows.withColumn("embedding", F.when(lacking, F.col("_made")).otherwise(F.col("embedding")))
            return rows

        self._change(changes, changed)
