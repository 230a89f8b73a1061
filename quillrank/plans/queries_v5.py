"""Queries of the title-first scorer, with and without the interpreter, and its comparison with the source-aware one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, ranking
from ..operators import interpretation as ip
from ..operators import scoring_v5 as v5
from ..sources import registry, views
from . import queries_v4

#: A preset of the dimensions' largest values besides the default one.
TITLE_HEAVY = v5.CONFIG | {"title_mission_fit": 75, "org_type_fit": 10, "generic_penalty": 30}


def _scores(spark: SparkSession, sf: str, config: dict[str, int] = v5.CONFIG, interpreted: bool = False) -> DataFrame:
    pool, _ = registry.split_active(views.opportunities(spark, sf))
    pool = ip.interpret(pool) if interpreted else pool
    return v5.score_v5(v5.pairs(pool, views.organizations(spark, sf), interpreted), config, interpreted)


def v5_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("org_id", "id", *v5.DIMENSIONS, "total", "confidence", "target", "fit_category")


def v5_preset_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, TITLE_HEAVY).select("org_id", "id", *v5.DIMENSIONS, "total", "confidence")


def v5_interpreted_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, interpreted=True).select("org_id", "id", *v5.DIMENSIONS, "total", "confidence", "target")


def v5_top10(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(_scores(spark, sf)).select("org_id", "id", "source", "total", "rank")


def v5_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = ranking.top_k(_scores(spark, sf))
    return top.select("org_id", "id", "rank", F.array_join("reasons", " | ").alias("reasons"), F.array_join("risks", " | ").alias("risks"))


def v5_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.funnel(_scores(spark, sf))


def v5_org_phrases(spark: SparkSession, sf: str) -> DataFrame:
    o = v5.org_features(views.organizations(spark, sf))
    plain = lambda a, f: F.array_join(F.transform(a, f), ",")
    return o.select("id", "kind", plain("phrases", lambda p: F.concat_ws(":", p["source"], p["phrase"])).alias("phrases"), plain("concepts", lambda w: F.concat_ws(":", w["w"], w["s"])).alias("concepts"), F.array_join("overlap", ",").alias("overlap"))


def compare_v4_v5(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of either scorer side by side."""
    lists = ((4, queries_v4.best(spark, sf)), (5, ranking.top_k(_scores(spark, sf))))
    a, b = (df.select("org_id", "id", F.col("total").alias(f"total_v{n}"), F.col("rank").alias(f"rank_v{n}")) for n, df in lists)
    return a.join(b, ["org_id", "id"], "full").withColumn("delta", F.col("rank_v4") - F.col("rank_v5"))


def queries() -> dict:
    every = (v5_scores, v5_preset_scores, v5_interpreted_scores, v5_top10, v5_explained_top10, v5_sweep, v5_org_phrases, compare_v4_v5)
    return {q.__name__: q for q in every}
