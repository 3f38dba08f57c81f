"""Session helpers: a configured local session for tests/bench and the shared
checkpoint folder taken from the session's own configuration."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "corvid") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context).  Without either, a session on a cluster gets an error: a folder of
    the driver's own would not be seen by the executors.  A local session, where
    all tasks run on this machine, gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        conf_dir = tempfile.mkdtemp(prefix="corvid-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and return a frame
    that reads it back: for results used more than once, so the plan that
    made them is not re-run per use, and a lost executor re-reads stored data
    instead of recomputing the lineage.  (Never a local checkpoint.)"""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df, work: float, rows: int, threshold: float = 5e7, rows_per_task: int = 50_000):
    """Deal a table with heavy work on each row over all cores: its few columns may lie in one
    file, or one row group, that a single task would read, however many rows it has.  Whole waves:
    every core gets as many of the equal tasks.  ``rows`` is known to the caller, so nothing runs
    to decide."""
    if work > threshold:
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(cores * max(1, -(-rows // (cores * rows_per_task))))
    return df
