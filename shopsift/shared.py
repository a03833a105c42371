"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local master gets a folder of its own where that is unset, a cluster an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="shopsift-")
    if not current.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The file system of ``path``, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    fs, target = hadoop(spark, path)
    fs.delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first; the cluster's own retention applies then
            return

    atexit.register(clear)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so that plans of loops stay short and lost executors cost no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
