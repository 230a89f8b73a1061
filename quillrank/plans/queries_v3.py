"""Queries of the specificity-first scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, bounds
from ..operators import scoring_v3 as v3
from ..sources import registry, views


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return registry.split_active(views.opportunities(spark, sf))[0]


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return v3.score_v3(v3.pairs(_pool(spark, sf), views.organizations(spark, sf)))


def best(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return bounds.best(*v3.bounded_sides(_pool(spark, sf), views.organizations(spark, sf)), v3.bound(), v3.score_v3, k)


def v3_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("org_id", "id", "passes_eligibility", *v3.DIMENSIONS, "semantic_boost", "penalty_total", "total")


def v3_top10(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf).select("org_id", "id", "total", "rank")


def v3_penalties(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.penalty_sums(_scores(spark, sf))


def v3_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.funnel(_scores(spark, sf))


def v3_phrases(spark: SparkSession, sf: str) -> DataFrame:
    o = v3.opp_features(views.opportunities(spark, sf))
    return o.select("id", F.array_join("phrases", ",").alias("phrases"), "intended", F.array_join("pops", ",").alias("populations"))


def queries() -> dict:
    return {q.__name__: q for q in (v3_scores, v3_top10, v3_penalties, v3_sweep, v3_phrases)}
