"""Ranking, caps, paging and comparison. Every order ends in `ord` or `id`, as Spark's sorts aren't stable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(scored: DataFrame, k: int, score: str, by: tuple[str, ...], least: int, name: str) -> DataFrame:
    """Numbers the eligible rows with `least` points or more, best first, and keeps k of each group.

    The points are compared behind the window only: a filter on a computed score before it would sink into the join that made the pairs, and there the score would be
    computed anew for each of its uses.
    """
    points = F.when(F.col("passes_eligibility") & (F.col(score) >= least), F.col(score))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_points"), F.asc("ord"))
    numbered = scored.withColumn("_points", points).withColumn(name, F.row_number().over(w))
    return numbered.where((F.col(name) <= k) & F.col("_points").isNotNull()).drop("_points")


def top_k(scored: DataFrame, k: int = 10, score: str = "total", by: str | tuple[str, ...] = "org_id", least: int = 1) -> DataFrame:
    """The k best eligible rows of each organization with a rank, ties in arrival order."""
    return _first(scored, k, score, (by,) if isinstance(by, str) else by, least, "rank").withColumn("rank", F.col("rank").cast("long"))


def capped_top_k(scored: DataFrame, k: int, cap: int, score: str = "total", by: str = "org_id", group: str = "source", least: int = 1) -> DataFrame:
    """As top_k, with at most `cap` rows of each source: what a walk down the sorted list that skips full sources would take."""
    return top_k(_first(scored, cap, score, (by, group), least, "_n").drop("_n"), k, score, by, least)


def first_per_key(rows: DataFrame, key: list[Column], order: Column) -> DataFrame:
    """One row per key, the first to arrive."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def unexpired(opps: DataFrame, close: Column, as_of: Column) -> DataFrame:
    """Drops rows whose close date lies before `as_of`; null and unreadable dates stay."""
    return opps.where(~F.coalesce(close < as_of, F.lit(False)))


def compare_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists (org_id, opp_id, score, rank) side by side, with deltas and a flag."""
    a = first.select("org_id", "opp_id", F.col("score").alias("score_1"), F.col("rank").alias("rank_1"))
    b = second.select("org_id", "opp_id", F.col("score").alias("score_2"), F.col("rank").alias("rank_2"))
    out = a.join(b, ["org_id", "opp_id"], "full_outer").withColumn("rank_delta", F.col("rank_1") - F.col("rank_2")).withColumn("score_delta", F.col("score_2") - F.col("score_1"))
    flag = F.when(F.col("rank_1").isNull(), "new").when(F.col("rank_2").isNull(), "dropped").when(F.col("rank_delta") >= 3, "rose").when(F.col("rank_delta") <= -3, "fell").otherwise("stable")
    return out.withColumn("flag", flag)


def compare_many(lists: dict[str, DataFrame]) -> DataFrame:
    """Ranked lists (org_id, opp_id, score, rank) by name, compared as `compare_named` does."""
    rows = reduce(DataFrame.unionByName, [df.select("org_id", "opp_id", "score", "rank", F.lit(name).alias("variant")) for name, df in lists.items()])
    return compare_named(rows, tuple(lists))


def compare_named(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Ranked rows with their list's name as `variant`, pivoted: score_<name> (0 if absent), rank_<name> (999), the spread of known ranks, and a flag from the first two names."""
    wide = rows.groupBy("org_id", "opp_id").agg(
        *[F.coalesce(F.max(F.when(F.col("variant") == n, F.col("score"))), F.lit(0)).alias(f"score_{n}") for n in names],
        *[F.coalesce(F.max(F.when(F.col("variant") == n, F.col("rank"))), F.lit(999)).alias(f"rank_{n}") for n in names],
        (F.max("rank") - F.min("rank")).alias("rank_spread"),
    )
    base, other = (F.col(f"rank_{n}") for n in names[:2])
    flag = F.when((base == 999) & (other < 999), "new").when(other < base - 2, "rises").when(other > base + 2, "falls").otherwise("stable")
    return wide.withColumn("flag", flag)
