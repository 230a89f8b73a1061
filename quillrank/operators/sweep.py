"""The whole sweep over a scored pool in one pass: funnel, histogram, source statistics, categories, means of the dimensions, boosts, and the best rows with their traces.

Everything is a mergeable aggregate, the best rows included: they are kept by a bounded queue for each organization and source, so that one task holds `k` rows of a group at most and the pool's rows
are neither sorted nor shuffled. What is shuffled is one row per task, organization and source; the step from sources to organizations adds these up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..functions.text import js_round
from .scoring_v2 import COMPLEXITY, TYPE_FIT

ABOVE = (30, 50, 70, 85)
TYPES = tuple(TYPE_FIT)


def _counts(hit: Column, profiled: bool) -> dict[str, Column]:
    """Numbers of pairs that add up over sources."""
    s = F.col("total")
    bins = {f"bin_{i}": F.count_if(hit & (F.least(F.lit(9), F.floor((s - 1) / 10)) == i)) for i in range(10)}
    above = {f"above_{n}": F.count_if(hit & (s > n)) for n in ABOVE}
    kinds = {f"type_{i}": F.count_if(hit & (F.col("type") == t)) for i, t in enumerate(TYPES)} | {f"complexity_{i}": F.count_if(hit & (F.col("complexity") == i)) for i in range(len(COMPLEXITY))} if profiled else {}
    return above | bins | kinds


def sweep(scored: DataFrame, dimensions: tuple[str, ...], boosts: tuple[str, ...] = (), k: int = 50, profiled: bool = True) -> DataFrame:
    """One row per organization.

    `scored` has org_id, id, ord, source, passes_eligibility, total, the dimensions and boosts, and, if `profiled`, type and complexity. The result has `active` (all pairs), `ineligible`, `eligible_zero`, `scored` and
    `above_<n>`; `histogram` (ten bins of positive scores); `types` and `complexities` (counts in the order of TYPES and COMPLEXITY, empty if not profiled); `dimension_tenths` (means in tenths, null without scored
    rows); `boosts` (sums); `by_source` (source, total, eligible, scored, mean in hundredths, highest; by source); `best`, the k best rows (total, id, dimensions), ties in arrival order. A null source is a source of
    its own; null totals count as no points.
    """
    ok, s = F.coalesce(F.col("passes_eligibility"), F.lit(False)), F.col("total")
    hit = ok & F.coalesce(s > 0, F.lit(False))
    sums = {f"sum_{c}": F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)) for c in ("total", *dimensions, *boosts)}
    counts = _counts(hit, profiled)
    # best first: the highest total, then the earliest arrival
    trace = F.struct(s.cast("long").alias("total"), (-F.col("ord")).alias("_before"), F.col("id"), F.array(*[F.col(d).cast("long") for d in dimensions]).alias("dimensions"))
    of_source = scored.groupBy("org_id", "source").agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(ok).alias("eligible"),
        F.count_if(hit).alias("scored"),
        F.coalesce(F.max(F.when(hit, s)), F.lit(0)).alias("top"),
        *[v.alias(n) for n, v in (counts | sums).items()],
        InternalFunction.collect_top_k(F.when(hit, trace), k, False).alias("best"),
    )
    c, add = F.col, lambda n: F.sum(n).alias(n)
    source = F.struct("source", F.col("active").alias("total"), "eligible", "scored", F.coalesce(js_round(c("sum_total") / F.nullif("scored", F.lit(0)) * 100), F.lit(0)).cast("long").alias("avg_x100"), "top")
    out = of_source.groupBy("org_id").agg(*[add(n) for n in ("active", "eligible", "scored", *counts, *sums)], F.sort_array(F.collect_list(source)).alias("by_source"), F.flatten(F.collect_list("best")).alias("best"))
    listed = lambda prefix, n: F.array(*[c(f"{prefix}_{i}") for i in range(n)]) if profiled else F.expr("cast(array() as array<bigint>)")
    return out.select(
        "org_id",
        "active",
        (c("active") - c("eligible")).alias("ineligible"),
        (c("eligible") - c("scored")).alias("eligible_zero"),
        "scored",
        *[f"above_{n}" for n in ABOVE],
        F.array(*[c(f"bin_{i}") for i in range(10)]).alias("histogram"),
        listed("type", len(TYPES)).alias("types"),
        listed("complexity", len(COMPLEXITY)).alias("complexities"),
        F.array(*[js_round(c(f"sum_{d}") / F.nullif("scored", F.lit(0)) * 10).cast("long") for d in dimensions]).alias("dimension_tenths"),
        F.array(*[c(f"sum_{b}").cast("long") for b in boosts]).alias("boosts") if boosts else F.expr("cast(array() as array<bigint>)").alias("boosts"),
        "by_source",
        F.transform(F.slice(F.sort_array("best", asc=False), 1, k), lambda t: F.struct(t["total"].alias("total"), t["id"].alias("id"), t["dimensions"].alias("dimensions"))).alias("best"),
    )
