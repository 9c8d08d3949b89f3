"""Spark session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every offerlake job relies on: UTC session clock (all buckets and
# epoch projections are UTC unless a tz parameter says otherwise), AQE for
# runtime coalescing / skew-join splitting, ANSI left at the Spark 4 default.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Streaming state (latest-per-key, watermarked windows, per-offer timers)
    # lives in RocksDB, off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "offerlake") -> SparkSession:
    """Create (or reuse) a session with the offerlake defaults.

    ``master=None`` keeps the master the launcher configured (spark-submit
    passes it as ``spark.master``); only when none is configured does it
    fall back to ``local[$BENCH_CPUS or 8]`` with that many shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    # spark-submit starts the JVM first (PYSPARK_GATEWAY_PORT) and passes the
    # master itself; so does an explicit --master in PYSPARK_SUBMIT_ARGS.
    launched = ("PYSPARK_GATEWAY_PORT" in os.environ
                or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    if master is None and not launched:
        master = f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "16g")
        # catalog metadata of external tables stays out of the working directory
        builder = builder.config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "offerlake-warehouse"))
        builder = builder.config("spark.sql.shuffle.partitions",
                                 str(shuffle_partitions or 8))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in BASE_CONF.items():
        if not k.startswith("spark.ui."):
            spark.conf.set(k, v)
    return spark


# RocksDB works outside the JVM's heap. Without a bound every partition of the state that an executor has met
# keeps buffers and a cache of its own; with it all of an executor's share one.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": BASE_CONF["spark.sql.streaming.stateStore.providerClass"],
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


@contextmanager
def rocksdb_state(spark: SparkSession, partitions: int):
    """Streams started inside keep their state in RocksDB, within bounds and in so many partitions, whatever store
    the session has: with Spark's default store a stateful processor fails."""
    conf = STATE_CONF | {"spark.sql.shuffle.partitions": str(partitions)}
    was = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``, which a cluster points at
    shared storage). Only a local session without one gets a fresh folder
    under /tmp, as in tests.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="offerlake-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
