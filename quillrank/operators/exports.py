"""Ranked lists as files: one file per organization, in rank order, with a header or an envelope.

The files are written by Spark's text writer, whose tasks commit by renaming: a task that fails leaves nothing that a reader would see. A list is as long as its rank allows, so one task
writes each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _write(lines: DataFrame, path: str, by: str, mode: str) -> None:
    """Lines (by, at, line) as one file for each value of `by`, in order of `at`."""
    dealt = lines.repartition(by).sortWithinPartitions(by, "at")
    dealt.select(by, F.col("line").alias("value")).write.mode(mode).partitionBy(by).text(path)


def write_csv(lines: DataFrame, header: tuple[str, ...], path: str, by: str = "org_id", mode: str = "error") -> None:
    """Lines (by, rank, line) of reports.csv_line or raw_csv_line below a header, one file for each organization. A line break within a quoted text stays within it."""
    heads = lines.select(by).distinct().select(by, F.lit(0).cast("long").alias("at"), F.lit(",".join(header)).alias("line"))
    _write(heads.unionByName(lines.select(by, F.col("rank").cast("long").alias("at"), "line")), path, by, mode)


def write_json(lines: DataFrame, facts: dict[str, Column], path: str, by: str = "org_id", mode: str = "error") -> None:
    """Lines (by, rank, line) of reports.json_line as one JSON document for each organization: the facts about it, the number of results, and the results in rank order.

    `facts` are aggregates over an organization's lines.
    """
    facts = {by: F.first(by)} | facts
    opening = lines.groupBy(by).agg(F.to_json(F.struct(*[v.alias(k) for k, v in facts.items()], F.count(F.lit(1)).alias("count"))).alias("f"))
    heads = opening.select(by, F.lit(0).cast("long").alias("at"), F.concat(F.expr("left(f, length(f) - 1)"), F.lit(',"results":[')).alias("line"))
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rank"))) == 1
    rows = lines.withColumn("_last", last).select(by, F.col("rank").cast("long").alias("at"), F.concat("line", F.when(F.col("_last"), "]}").otherwise(",")).alias("line"))
    _write(heads.unionByName(rows), path, by, mode)


def read_lines(spark: SparkSession, path: str, by: str = "org_id") -> DataFrame:
    """The files' lines (by, line), for checks; each file is whole in its own order only when read by itself."""
    return spark.read.schema(f"value string, {by} string").text(path).select(by, F.col("value").alias("line"))
