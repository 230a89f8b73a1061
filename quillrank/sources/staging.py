"""Intermediate tables in the folder that driver and executors share.

A written table cuts a plan where several scans need what is costly to derive, and it survives the loss of executors. The folder is the session's spark.checkpoint.dir; a local
session without one gets a temporary one, and a cluster session without one is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = now.get() if now.isDefined() else None
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the gateway may be gone; the folder is then left to its owner
        remove(spark, path)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the session's process ends."""
    path = f"{shared_folder(spark)}/quillrank/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet and read back; see own_folder."""
    path = own_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
