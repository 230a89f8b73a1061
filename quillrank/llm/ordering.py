"""A global order over a distributed table without passing it through one task.

Rows are dealt by ranges of the sort key and written once; each part then needs only the totals of the parts before
it, a table with one row a part, to know where its own rows begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch


def with_prefix(df: DataFrame, order: list[Column], scratch: Scratch, size: str | None = None) -> DataFrame:
    """Adds `row_at` (rows before this one in the order) and, given a column `size`, `size_at` (their total size) and
    `size_all` (the table's).

    Rows that are equal in all of `order` come in any order. A null size counts as 0.
    """
    amount = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(0)
    parts = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(amount.cast("long")).alias("_size"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_sizes"), F.sum("_size").over(Window.partitionBy()).alias("size_all"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(starts), "_part").withColumn("row_at", F.col("_rows") + F.count(F.lit(1)).over(within) - 1)
    if size:
        out = out.withColumn("size_at", F.col("_sizes") + F.sum(amount.cast("long")).over(within) - amount)
    return out.drop("_part", "_rows", "_sizes", *[] if size else ["size_all"])
