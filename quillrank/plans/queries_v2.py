"""Queries of the profile scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings
from ..operators import analysis, bounds
from ..operators import scoring_hybrid as hybrid
from ..operators import scoring_v2 as v2
from ..sources import registry, views

_FUNDING = ("micro", "small", "medium", "large", "enterprise")


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return registry.split_active(views.opportunities(spark, sf))[0]


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return v2.score_v2(v2.pairs(_pool(spark, sf), views.organizations(spark, sf)))


def best(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return bounds.best(*v2.bounded_sides(_pool(spark, sf), views.organizations(spark, sf)), v2.bound(), v2.score_v2, k)


def _opps(spark: SparkSession, sf: str) -> DataFrame:
    return v2.opp_profiles(views.opportunities(spark, sf))


def v2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("org_id", "id", "passes_eligibility", *v2.DIMENSIONS, "base_score", "semantic_boost", "penalty_total", "total")


def v2_top10(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf).select("org_id", "id", "total", "rank")


def v2_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.funnel(_scores(spark, sf))


def sector_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).select("id", F.array_join("sectors", ",").alias("sectors"))


def activity_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).select("id", F.array_join("activities", ",").alias("activities"))


def population_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).select("id", F.array_join("populations", ",").alias("populations"))


def opportunity_type(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).select("id", "type")


def complexity_band(spark: SparkSession, sf: str) -> DataFrame:
    return _opps(spark, sf).select("id", F.get(strings(v2.COMPLEXITY), F.col("complexity")).alias("complexity"), F.get(strings(_FUNDING), F.col("funding_band")).alias("funding_band"))


def capacity_band(spark: SparkSession, sf: str) -> DataFrame:
    orgs = v2.org_profiles(views.organizations(spark, sf))
    return orgs.select("id", "class", F.get(strings(v2.BANDS), F.col("capacity")).alias("capacity"), "scope", "procurement_readiness", "research_readiness")


def penalty_sum(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.penalty_sums(_scores(spark, sf))


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.score_hybrid(hybrid.pairs(_pool(spark, sf), views.organizations(spark, sf)))


def best_hybrid(spark: SparkSession, sf: str, k: int = 10, cap: int | None = None, least_pairs: int = bounds.LEAST_PAIRS) -> DataFrame:
    """The hybrid's best; what only the bound needs is left out where all pairs are scored. No query shows the description, which would be written once more."""
    pool, orgs = _pool(spark, sf), views.organizations(spark, sf)
    mine, own = (hybrid.sides if pool.count() * orgs.count() < least_pairs else hybrid.bounded_sides)(pool, orgs)
    return bounds.best(mine.drop("description"), own, hybrid.bound(), hybrid.score_hybrid, k, cap, least_pairs=least_pairs)


def hybrid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("org_id", "id", "passes_eligibility", *hybrid.DIMENSIONS, "semantic_boost", "maturity_boost", "penalty_total", "total")


def hybrid_top10(spark: SparkSession, sf: str) -> DataFrame:
    return best_hybrid(spark, sf).select("org_id", "id", "total", "rank")


def hybrid_capped_top(spark: SparkSession, sf: str) -> DataFrame:
    return best_hybrid(spark, sf, cap=3).select("org_id", "id", "source", "total", "rank")


def hybrid_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.histogram(_hybrid(spark, sf))


def queries() -> dict:
    every = (v2_scores, v2_top10, v2_sweep, sector_tags, activity_tags, population_tags, opportunity_type, complexity_band, capacity_band, penalty_sum, hybrid_scores, hybrid_top10, hybrid_capped_top, hybrid_histogram)
    return {q.__name__: q for q in every}
