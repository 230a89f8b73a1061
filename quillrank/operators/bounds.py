"""The exact best opportunities of each organization without scoring every pair in full.

A scorer comes with a bound: points that no pair of such sides can exceed (null where a pair fails the gate), from short arrays and numbers of either side, and from what an opportunity is worth at most to each class of
organization, which is derived once on its side. The pairs with the highest bounds are scored first. Where they fill the list, its last row is a floor: a pair whose bound is lower
cannot enter the list, nor one whose bound equals it but that arrived later, and only the others are scored in full.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strings, table
from ..sources.staging import staged
from . import ranking
from .pairs import CLASSES, pair_up

Scorer = Callable[[DataFrame], DataFrame]
#: Below so many pairs, planning and compiling the search for a floor takes longer than scoring every pair. The rows are the same either way.
LEAST_PAIRS = 2_000_000


def with_class_points(opps: DataFrame, gate: Column, points: Column) -> DataFrame:
    """Adds `class_points`: for each of CLASSES the points of an organization of that class with the best flags, null where even that fails the gate.

    gate and points may use the opportunity's columns, org_class, org_has_501c3 and org_is_small_business; they must not fall when a flag is set.
    """
    out, names = opps, [f"_class{i}" for i in range(len(CLASSES))]
    for name, c in zip(names, CLASSES, strict=True):
        out = out.withColumns({"org_class": F.lit(c), "org_has_501c3": F.lit(True), "org_is_small_business": F.lit(True)}).withColumn(name, F.when(gate, points).cast("int"))
    return out.withColumn("class_points", F.array(*names)).drop(*names, "org_class", "org_has_501c3", "org_is_small_business")


def class_points() -> Column:
    """A pair's entry of class_points."""
    return F.get("class_points", (F.array_position(strings(CLASSES), F.col("org_class")) - 1).cast("int"))


def highest(bounded: DataFrame, n: int, by: tuple[str, ...]) -> DataFrame:
    """The n pairs with the highest bounds `most` in each group, ties in arrival order. `bounded` should be a written table, as it is read twice.

    A sort of all pairs would cost more than their bounds. Bounds are small whole numbers: pairs are counted by bound first, and only those are sorted whose bound lets fewer than n others lie above it.
    """
    known = bounded.where(F.col("most").isNotNull())
    above = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("most")).rowsBetween(Window.unboundedPreceding, -1))
    counted = known.groupBy(*by, "most").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(above, F.lit(0)))
    edges = counted.where(F.col("_above") < n).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("most").alias("_edge"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    near = known.join(F.broadcast(edges), same & (F.col("most") >= F.col("_edge")))  # a row per organization (and source) is broadcast
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("most"), F.asc("ord")))
    return near.withColumn("_n", place).where(F.col("_n") <= n).select(*bounded.columns)


def points_of_cases(prefixed_orgs: DataFrame, name: str, cases: list[dict], kinds: str, points: Column) -> DataFrame:
    """(org_id, name): what each organization gets in each case, in the order of the cases, so that a pair looks its points up.

    A case gives values to an opportunity's columns, whose types `kinds` names; the points may use them and the organization's columns.
    """
    rows = prefixed_orgs.select("*", F.posexplode(table(cases, f"array<struct<{kinds}>>")).alias("_at", "_case")).select("*", "_case.*")
    rows = rows.select("org_id", F.struct("_at", points.cast("int").alias("points")).alias("_p"))
    return rows.groupBy("org_id").agg(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["points"]).alias(name))


def candidates(opps: DataFrame, orgs: DataFrame, bound: Column, score: Scorer, rank: Scorer, k: int, least: int, seeds: int, by: tuple[str, ...]) -> DataFrame:
    """The pairs whose bound reaches the floor of their organization, with all columns of both sides. `opps` should be a written table, as it is read three times.

    The floor is the k-th row among what `rank` makes of the `seeds` pairs with the highest bounds in each group `by`, or `least` points where those don't give k rows.
    """
    first = highest(staged(pair_up(opps, orgs).select("org_id", "id", "ord", "source", bound.alias("most")), "bounds"), seeds, by).select("org_id", "id").distinct()
    own = orgs.select(*[F.col(c).alias(c if c.startswith("org_") else f"org_{c}") for c in orgs.columns])
    tried = opps.join(F.broadcast(first), "id").join(F.broadcast(own), "org_id")  # seeds times organizations (and sources) at most
    floors = staged(rank(score(tried)).where(F.col("rank") == k).select(F.col("org_id").alias("of"), F.col("total").alias("floor"), F.col("ord").alias("floor_ord")), "floors")
    aimed = orgs.join(F.broadcast(floors), F.col("id") == F.col("of"), "left").withColumn("floor", F.coalesce("floor", F.lit(least))).drop("of")
    later = F.coalesce(F.col("ord") > F.col("org_floor_ord"), F.lit(False))
    return pair_up(opps, aimed).where(bound >= F.col("org_floor") + F.when(later, 1).otherwise(0))


def best(opps: DataFrame, orgs: DataFrame, bound: Column, score: Scorer, k: int = 10, cap: int | None = None, least: int = 1, seeds: int | None = None, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """What ranking.top_k (or, with `cap`, capped_top_k) makes of all pairs' scores; from the candidates alone where there are `least_pairs` or more."""
    rank = (lambda rows: ranking.capped_top_k(rows, k, cap, least=least)) if cap else (lambda rows: ranking.top_k(rows, k, least=least))
    by, seeds = (("org_id", "source"), seeds or 20 * cap) if cap else (("org_id",), seeds or 20 * k)
    opps = staged(opps, "opportunities")
    if opps.count() * orgs.count() < least_pairs:
        return rank(score(pair_up(opps, orgs)))
    return rank(score(candidates(opps, orgs, bound, score, rank, k, least, seeds, by)))
