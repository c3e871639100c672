"""Session helpers."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", partitions=8, memory="16g"):
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pressmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("pressmill.read.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark):
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may name none: its executors run in the driver, which then uses a
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(tempfile.gettempdir(), "pressmill-shared")
    return configured.rstrip("/")


def ensure_checkpoint_dir(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def once(df):
    """A result that several queries or branches read, computed once: a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_shared_path(spark, label):
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
