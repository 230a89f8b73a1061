"""Tables and files in the folder that driver and executors share.

The folder is the session's spark.checkpoint.dir; a local session without one (tests, a laptop) gets a temporary one, and a cluster session is refused.
Cutting a plan with a written table costs one write and survives the loss of executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python
ROW_GROUP_BYTES = 16 << 20  # that a task holds back while it writes Parquet
HOT = 100_000  # rows of one key


class Scratch:
    """A folder of intermediate tables, removed when the session's process ends or by `clear`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/quillrank/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str = "table", by: Sequence[str] = (), codec: str = "snappy") -> DataFrame:
        """The same rows, read back from Parquet, which has a folder for each value of the columns `by`."""
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path, partitionBy=list(by) or None, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Removes one saved table that nothing will read again."""
        _delete(self.spark, table.scratch_path)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                _delete(self.spark, self.path)
            elif self.path.startswith("file:"):
                import shutil

                shutil.rmtree(self.path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        except Exception:  # noqa: BLE001  the session's gateway may be gone at exit; the folder is then left to its owner
            return


def shared_folder(spark: SparkSession) -> str:
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = now.get() if now.isDefined() else None
    master = spark.sparkContext.master
    if not set_dir and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not set_dir:
        set_dir = "file://" + tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def bounded(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A table of keys, marked for broadcasting if it is counted to have few rows; Spark joins a larger one as it sees fit."""
    return F.broadcast(keys) if keys.count() <= most else keys


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches where it still is Spark's default: each Python worker holds a few batches at once."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == "67108864b":
        spark.conf.set(setting, str(BATCH_BYTES))


def free_name(table: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken, name = {c.lower() for c in table.columns}, f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def join_one(rows: DataFrame, table: DataFrame, key: str, size: str, hot: int = HOT) -> DataFrame:
    """Inner join of rows with a saved table that has one row per key, whose column `size` tells how many of the rows have it.

    The rows of keys above `hot` meet their table row by broadcast, which leaves them where they are; there can be no more such keys than
    rows / hot. All others are shuffled by the key.
    """
    frequent = table.where(F.col(size) > hot)
    n = frequent.count()
    if not 0 < n <= 2_000_000:
        return rows.join(table, key)
    met = rows.join(F.broadcast(frequent), key)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(table.where(F.col(size) <= hot), key)
    return met.unionByName(rest)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
