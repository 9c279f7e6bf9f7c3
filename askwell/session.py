"""Session helpers: a local session for tests and bench, and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "askwell") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path every executor can reach, below the cluster's ``spark.checkpoint.dir``; it is deleted when the
    application ends.

    Only in local mode, as in tests, may that setting be missing: all tasks then share the driver's disk, and a
    temporary folder is made and set. Elsewhere a machine's own folder would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="askwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/askwell/{purpose}-{uuid.uuid4().hex}"
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(settings)
    system.mkdirs(folder.getParent())
    system.deleteOnExit(folder)
    return path
