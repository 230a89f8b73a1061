"""Queries of the source-aware scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..operators import analysis, bounds, ranking
from ..operators import scoring_v4 as v4
from ..sources import registry, views

AS_OF = "2026-04-01 00:00:00"


def _pool(spark: SparkSession, sf: str, drop_expired: bool = False) -> DataFrame:
    pool, _ = registry.split_active(views.opportunities(spark, sf))
    return ranking.unexpired(pool, parse_date(F.col("close_date")), _as_of()) if drop_expired else pool


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _scores(spark: SparkSession, sf: str, drop_expired: bool = False) -> DataFrame:
    return v4.score_v4(v4.pairs(_pool(spark, sf, drop_expired), views.organizations(spark, sf), _as_of()))


def best(spark: SparkSession, sf: str, drop_expired: bool = False, k: int = 10, cap: int | None = None, least: int = 1) -> DataFrame:
    """The ranked list, of pairs whose bound lets them in."""
    return bounds.best(*v4.bounded_sides(_pool(spark, sf, drop_expired), views.organizations(spark, sf), _as_of()), v4.bound(), v4.score_v4, k, cap, least)


def v4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("org_id", "id", "passes_eligibility", *v4.DIMENSIONS, "semantic_boost", "recency_boost", "penalty_total", "total", "confidence")


def v4_capped_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Unexpired rows of active sources with 25 points or more, three a source at most."""
    return best(spark, sf, True, cap=3, least=25).select("org_id", "id", "source", "total", "rank")


def v4_penalties(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.penalty_sums(_scores(spark, sf))


def v4_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.funnel(_scores(spark, sf))


def recency_boost(spark: SparkSession, sf: str) -> DataFrame:
    return v4.opp_features(views.opportunities(spark, sf), _as_of()).select("id", F.col("recency_boost").cast("long").alias("recency_boost"))


def phrase_extract(spark: SparkSession, sf: str) -> DataFrame:
    o = v4.opp_features(views.opportunities(spark, sf), _as_of())
    return o.select("id", F.array_join("phrases", ",").alias("phrases"), "intended")


def population_specificity(spark: SparkSession, sf: str) -> DataFrame:
    o = v4.opp_features(views.opportunities(spark, sf), _as_of())
    return o.select("id", F.array_join("pops", ",").alias("populations"), v4.specificity(F.col("pops")).cast("long").alias("specificity"))


def queries() -> dict:
    every = (v4_scores, v4_capped_top10, v4_penalties, v4_sweep, recency_boost, phrase_extract, population_specificity)
    return {q.__name__: q for q in every}
