"""Session set-up shared by the entry points, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "meshloom") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that cuts lineage: the session's own setting, or a local one where none is set and the session is a single JVM.

    A cluster must name it in ``spark.checkpoint.dir``, as only then all executors reach it. The local folder is removed at the end.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="meshloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def materialise(df):
    """Writes a result to the checkpoint folder and reads it back, so later steps share one computation and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df, max_rows: int):
    """A materialised side as a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffle join then handles it)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df, scan=None):
    """Rows dealt out over all cores where the scan they come from has fewer parts than there are cores, as one small file has; else as they are.

    ``scan`` must be a plain read, whose parts are known without running anything; by default it is ``df`` itself.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # the number of parts is asked of the plan; nothing is worked on as an RDD
    return df.repartition(cores) if (scan or df).rdd.getNumPartitions() < cores else df
