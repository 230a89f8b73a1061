"""Sweeps over whole scored pools, ranking metrics, failure classes and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, strings
from .scoring_v1 import GENERIC

RELEVANT = ("strong_fit", "possible_fit", "good")


def funnel(scored: DataFrame, score: str = "total") -> DataFrame:
    """One row per organization: ineligible, eligible without points, scored, and the numbers above 30, 50, 70 and 85."""
    ok, s = F.col("passes_eligibility"), F.col(score)
    return scored.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(~ok).alias("ineligible"),
        F.count_if(ok & (s == 0)).alias("eligible_zero"),
        F.count_if(ok & (s > 0)).alias("scored"),
        *[F.count_if(ok & (s > n)).alias(f"above_{n}") for n in (30, 50, 70, 85)],
    )


def histogram(scored: DataFrame, score: str = "total") -> DataFrame:
    """Ten bins of positive scores per organization; empty bins are present."""
    s = F.col(score)
    bins = [F.count_if(F.col("passes_eligibility") & (s > 0) & (F.least(F.lit(9), F.floor((s - 1) / 10)) == i)) for i in range(10)]
    return scored.groupBy("org_id").agg(F.array(*bins).alias("n")).select("org_id", F.posexplode("n").alias("bin", "n"))


def by_source(scored: DataFrame, score: str = "total") -> DataFrame:
    """Per organization and source: total, eligible, scored, mean (two decimals) and highest score."""
    ok, s = F.col("passes_eligibility"), F.col(score)
    hit = F.when(ok & (s > 0), s)
    return scored.groupBy("org_id", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("eligible"), F.count(hit).alias("scored"), F.coalesce(js_round(F.avg(hit) * 100), F.lit(0)).cast("long").alias("avg_x100"), F.coalesce(F.max(hit), F.lit(0)).alias("top")
    )


def category_counts(scored: DataFrame, column: str, score: str = "total") -> DataFrame:
    """Counts of a category over scored rows."""
    return scored.where(F.col("passes_eligibility") & (F.col(score) > 0)).groupBy("org_id", F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def dimension_means(scored: DataFrame, dimensions: tuple[str, ...], score: str = "total") -> DataFrame:
    """Mean of each dimension over scored rows, in tenths (rounded half up)."""
    kept = scored.where(F.col("passes_eligibility") & (F.col(score) > 0))
    return kept.groupBy("org_id").agg(*[js_round(F.sum(d) / F.count(F.lit(1)) * 10).cast("long").alias(d) for d in dimensions])


def each_of(scored: DataFrame, items: Column, name: str) -> DataFrame:
    """(org_id, `name`): a row for each item of a list that is computed from scored pairs; none for a null or empty list.

    Neither a filter on the score nor `explode`, from which Spark infers one on the list's size, comes before the items: either would sink into the condition of the join that makes the
    pairs, where all that the list is made of is computed anew for each of its uses.
    """
    return scored.select("org_id", F.posexplode_outer(items).alias("_at", name)).where("_at is not null").drop("_at")


def penalty_sums(scored: DataFrame) -> DataFrame:
    """Per organization and type of penalty: its points and how often it applies."""
    each = each_of(scored, F.col("penalties"), "p")
    return each.groupBy("org_id", F.col("p.type").alias("type")).agg(F.sum("p.value").alias("value"), F.count(F.lit(1)).alias("n"))


def risk_counts(scored: DataFrame, score: str = "total") -> DataFrame:
    """How often each risk occurs over scored rows, cut at the first dash or parenthesis."""
    kept = each_of(scored, F.when(F.col("passes_eligibility") & (F.col(score) > 0), F.col("risks")), "risk")
    return kept.select("org_id", F.trim(F.regexp_replace("risk", r"(?s)\s*[—(].*$", "")).alias("risk")).groupBy("org_id", "risk").agg(F.count(F.lit(1)).alias("n"))


def score_counts(scored: DataFrame, score: str = "total") -> DataFrame:
    """(org_id, ok, s, n): how many pairs of each organization have which score, which is all that sums, shares and medians need."""
    return scored.groupBy("org_id", F.col("passes_eligibility").alias("ok"), F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))


def upper_median(scored: DataFrame, score: str = "total") -> DataFrame:
    """The upper of the middle scores of eligible rows, by counting scores rather than gathering them."""
    return _upper_median(score_counts(scored, score))


def _upper_median(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("org_id")
    upto = F.sum("n").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = counts.where("ok").withColumn("upto", upto).withColumn("all", F.sum("n").over(w))
    return marked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("org_id").agg(F.min("s").alias("median_score"))


def metrics(scored: DataFrame, ranked: DataFrame, labels: DataFrame, score: str = "total") -> DataFrame:
    """One row per organization: counts, means, the five-part distribution, precision, recall and feedback of the ranked list.

    `ranked` has org_id, opp_id and rank; `labels` has org_id, opp_id, eval_label and feedback. Precision and recall are null without labels.
    """
    counts, ok, s, n = score_counts(scored, score), F.col("ok"), F.col("s"), F.col("n")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    base = counts.groupBy("org_id").agg(
        F.sum("n").alias("total_scored"),
        of(ok).alias("eligible"),
        of(~ok).alias("ineligible"),
        F.coalesce(js_round(F.sum(F.when(ok, s * n)) / F.sum(F.when(ok, n))), F.lit(0)).cast("long").alias("avg_score"),
        js_round(of(~ok) / F.sum("n") * 100).cast("long").alias("filtered_pct"),
        *[of(ok & (s > lo) & (s <= hi)).alias(f"upto_{hi}") for lo, hi in ((-1, 20), (20, 40), (40, 60), (60, 80), (80, 10_000))],
    )
    known = labels.select("org_id", "opp_id", "feedback", F.col("eval_label").isin(*RELEVANT).alias("relevant"))
    per_org = known.groupBy("org_id").agg(F.count(F.lit(1)).alias("labeled"), F.count_if("relevant").alias("n_relevant"))
    rating = F.when(F.col("feedback") == "good", 3).when(F.col("feedback") == "weak", 2).when(F.col("feedback") == "bad", 1).otherwise(0)
    top = ranked.where("rank <= 10").join(known, ["org_id", "opp_id"], "left").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("n10"),
        F.count_if(F.col("rank") <= 5).alias("n5"),
        F.count_if("relevant").alias("r10"),
        F.count_if(F.col("relevant") & (F.col("rank") <= 5)).alias("r5"),
        F.count_if(F.col("feedback") == "bad").alias("bad_in_top_10"),
        js_round(F.avg(F.when(F.col("feedback").isNotNull(), rating)) * 100).cast("long").alias("avg_rating_x100"),
    )
    out = base.join(_upper_median(counts), "org_id", "left").join(top, "org_id", "left").join(per_org, "org_id", "left")
    percent = lambda a, b: F.when((F.col("labeled") > 0) & (F.col(b) > 0), js_round(F.coalesce(a, F.lit(0)) / F.col(b) * 100).cast("long"))
    out = out.withColumn("precision_at_5", percent("r5", "n5")).withColumn("precision_at_10", percent("r10", "n10")).withColumn("recall", percent("r10", "n_relevant"))
    return out.withColumn("bad_in_top_10", F.coalesce("bad_in_top_10", F.lit(0))).withColumn("median_score", F.coalesce("median_score", F.lit(0))).drop("n5", "n10", "r5", "r10", "labeled", "n_relevant")


def failure_classes(scored: DataFrame, ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(org_id, class, opp_id) for six kinds of suspicious rows; the three taken from the whole pool are its first five in arrival order.

    `scored` is the audit scorer's table, `ranked` its ranked rows with matched_tokens and dimensions.
    """
    feedback = labels.select("org_id", F.col("opp_id").alias("id"), "feedback")
    r = ranked.where("rank <= 20").join(feedback, ["org_id", "id"], "left")
    generic = strings(GENERIC)
    some = F.size("matched_tokens") > 0
    found = [
        r.where("rank <= 10").where((F.coalesce(F.col("feedback"), F.lit("")) == "bad") | (~some & (F.col("total") > 20))).select("org_id", F.lit("false_positive").alias("class"), "id"),
        r.where(some & (F.size(F.array_except("matched_tokens", generic)) == 0) & (F.col("mission_topic_fit") > 10)).select("org_id", F.lit("generic_keyword_hit").alias("class"), "id"),
        r.where("geography_fit = 0").select("org_id", F.lit("geo_mismatch").alias("class"), "id"),
    ]
    outside = scored.join(r.select("org_id", "id"), ["org_id", "id"], "left_anti").join(feedback.where("feedback = 'good'"), ["org_id", "id"], "left_semi")
    first = lambda rows, name: rows.withColumn("_n", F.row_number().over(Window.partitionBy("org_id").orderBy("ord"))).where("_n <= 5").select("org_id", F.lit(name).alias("class"), "id")
    found += [
        first(outside.where("total < 30"), "false_negative"),
        first(scored.where((F.coalesce("max_award", F.lit(0)) > 0) & (F.col("funding_size_fit") <= 3)), "funding_outlier"),
        first(scored.where(~F.col("passes_eligibility")), "eligibility_edge_case"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("id", "opp_id")


def recommendations(ranked: DataFrame, metrics: DataFrame, weight: int = 60) -> DataFrame:
    """(org_id, priority, category) from nine threshold rules over the top rows' aggregates and the metrics.

    `ranked` holds the audit scorer's top 20 with matched_tokens; `weight` is the mission dimension's highest value.
    """
    n = F.size("matched_tokens")
    top = ranked.where("rank <= 20").groupBy("org_id").agg(
        F.avg(F.when(F.col("rank") <= 10, F.col("mission_topic_fit"))).alias("mission"),
        F.count_if(n == 0).alias("zero"),
        F.count_if((n < 4) & F.arrays_overlap("matched_tokens", strings(GENERIC))).alias("generic"),
        F.count_if(F.col("geography_fit") == 0).alias("geo_zero"),
        F.count_if(F.coalesce("max_award", F.lit(0)) == 0).alias("no_amount"),
        F.count_if(n < 3).alias("thin"),
    )
    m = metrics.join(top, "org_id", "left")

    def rule(when: Column, priority: str, category: str) -> Column:
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category")))

    rules = (
        rule(F.col("mission") < weight * 0.5, "high", "Scoring Weights"),
        rule(F.col("zero") > 3, "high", "Keyword Matching"),
        rule(F.col("generic") > 3, "medium", "Keyword Quality"),
        rule(F.col("geo_zero") > 8, "medium", "Geography"),
        rule((F.col("filtered_pct") < 10) & (F.col("total_scored") > 50), "medium", "Eligibility"),
        rule((F.col("avg_score") < 30) & F.col("mission").isNotNull(), "medium", "Calibration"),
        rule(F.col("no_amount") > 10, "low", "Funding Data"),
        rule(F.col("bad_in_top_10") > 0, "high", "False Positives"),
        rule(F.col("thin") > 5, "low", "Synonym Expansion"),
    )
    return m.select("org_id", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("org_id", "r.priority", "r.category")


def term_counts(rows: DataFrame, key: str, tokens: Column, most: int = 15) -> DataFrame:
    """The most frequent terms of each row, ties in order of first occurrence.

    The rows are dealt by their key once, as they are; counting and ranking their terms then shuffles nothing more.
    """
    each = rows.repartition(F.col(key)).select(key, F.posexplode(tokens).alias("at", "term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    return each.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).drop("at")
