"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Static ones go into the builder, the rest can
# also be applied to a session somebody else made (see ``prepare``).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Many small folders: by default each of up to 10,000 of them is listed by a task of its own.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
    # Keyed stream state may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "packetmill", master: str | None = None, **conf) -> SparkSession:
    """A session for local use; on a cluster the submitter sets master and memory."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = "".join(c for c in master if c.isdigit()) or str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.driver.memory", os.environ.get("PACKETMILL_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session created elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only on a local master without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="packetmill-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores by their values.

    For heavy work on few columns: a file is read by at most as many tasks as it has row groups, which may be one.
    """
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(max(int(conf), df.sparkSession.sparkContext.defaultParallelism), *df.columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores by unique keys and sorted by them there.

    For training: samples that Spark ML draws follow tasks and order, so a rerun on as many cores draws the same ones.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate or stream checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Paths that the open blocks of ``passing_tables`` have written, the innermost block last.
_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside go when the block ends.

    What is read later has to be written with ``keep=True``. When the block fails its tables stay.
    """
    _passing.append([])
    try:
        yield
    except BaseException:
        _passing.pop()
        raise
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _passing.pop():
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    For results that several later steps read: they are computed once, survive lost
    executors, and come back with file statistics, so later joins know their size. Inside of ``passing_tables``
    they go with the block, unless ``keep`` is set.
    """
    path = scratch_path(df.sparkSession, name)
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
