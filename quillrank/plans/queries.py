"""The engine's queries by name: operators applied to the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, ranking, store
from ..operators import scoring_v1 as v1
from ..operators.keyed_store import KeyedStore
from ..sources import registry, staging, views
from ..streaming import events as ev

AS_OF = "2026-04-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_KEYS = ("org_id", "id")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return v1.v1_scores(views.opportunities(spark, sf), views.organizations(spark, sf))


def _audit(spark: SparkSession, sf: str, variant: str = "v1_current") -> DataFrame:
    """The audit scorer takes the pool as it is, historical sources included."""
    weights, synonyms = v1.VARIANTS[variant]
    return v1.score_audit(v1.pairs(views.opportunities(spark, sf), views.organizations(spark, sf)), weights, synonyms)


def _list(df: DataFrame) -> DataFrame:
    return df.select("org_id", F.col("id").alias("opp_id"), F.col("total").alias("score"), "rank")


def v1_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select(*_KEYS, "passes_eligibility", *v1.DIMENSIONS, "total")


def v1_top10(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(_scores(spark, sf)).select(*_KEYS, "source", "total", "rank")


def _ranked(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return v1.ranked_v1(views.opportunities(spark, sf), views.organizations(spark, sf), k)


def v1_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = v1.reasons_v1(_ranked(spark, sf, 10))
    return top.select(*_KEYS, "rank", F.array_join("reasons", " | ").alias("reasons"), F.array_join("risks", " | ").alias("risks"))


def v1_capped_top(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.capped_top_k(_scores(spark, sf), k=10, cap=3).select(*_KEYS, "source", "total", "rank")


def _variants(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """The 20 best of each organization by each variant, all from one pass over the pairs."""
    scored = v1.score_variants(v1.pairs(views.opportunities(spark, sf), views.organizations(spark, sf)), names or tuple(v1.VARIANTS))
    return ranking.top_k(scored, 20, by=("variant", "org_id"))


def audit_weighted_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _variants(spark, sf).select("variant", *_KEYS, "total", "rank")


def audit_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select(*_KEYS, "passes_eligibility", *v1.DIMENSIONS, "total", F.size("matched_tokens").cast("long").alias("n_matched"))


def compare_v1_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.compare_two(_list(ranking.top_k(_scores(spark, sf), 20)), _list(ranking.top_k(_audit(spark, sf), 20)))


def compare_variants(spark: SparkSession, sf: str) -> DataFrame:
    names = ("v1_current", "v1_mission_heavy", "v1_synonyms")
    return ranking.compare_named(_variants(spark, sf, *names).select("variant", "org_id", F.col("id").alias("opp_id"), F.col("total").alias("score"), "rank"), names)


def sweep_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.funnel(_scores(spark, sf))


def sweep_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.histogram(_scores(spark, sf))


def sweep_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.by_source(_scores(spark, sf))


def sweep_types(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.category_counts(_scores(spark, sf), "funding_type")


def dimension_avgs(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.dimension_means(_scores(spark, sf), v1.DIMENSIONS)


def risk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.risk_counts(v1.reasons_v1(_scores(spark, sf)))


def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.upper_median(_audit(spark, sf))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = _audit(spark, sf)
    return analysis.metrics(scored, _list(ranking.top_k(scored, 20)), views.evaluation_labels(spark, sf))


def metrics_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    scored = _audit(spark, sf)
    return analysis.failure_classes(scored, ranking.top_k(scored, 20), views.evaluation_labels(spark, sf))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.recommendations(ranking.top_k(_audit(spark, sf), 20), _metrics(spark, sf))


def active_filter(spark: SparkSession, sf: str) -> DataFrame:
    return registry.split_active(views.opportunities(spark, sf))[0].select("id", "source")


def source_alias(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.opportunities(spark, sf).select("id", F.when(F.col("ord") % 3 == 0, "SBIR (via USASpending)").when(F.col("ord") % 3 == 1, "World Bank").otherwise(F.col("source_raw")).alias("raw"))
    return raw.select("id", registry.source_key(F.col("raw")).alias("source"))


def expired_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.unexpired(views.opportunities(spark, sf), T.parse_date(F.col("close_date")), F.lit(AS_OF).cast("timestamp")).select("id", "close_date")


def pool_search(spark: SparkSession, sf: str) -> DataFrame:
    return store.pool_search(views.opportunities(spark, sf), "Energy", funding_type="grant").select("id")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The opportunities as stored records."""
    o, classes = views.opportunities(spark, sf), registry.registry(spark).select("source", "classification")
    key = T.dedupe_key(F.col("source"), F.col("ord").cast("string"))
    stored = o.join(F.broadcast(classes), "source").withColumn("source_record_id", F.col("ord").cast("string")).withColumn("dedupe_key", key).withColumn("id", T.record_id_hash(key))
    return stored.withColumn("raw_payload", F.lit(None).cast("string")).withColumn("normalized_at", F.timestamp_seconds(F.lit(1_767_225_600) + F.pmod(F.col("ord") * 37, F.lit(5000))))


def deterministic_id(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("id", "dedupe_key")


def ilike_search(spark: SparkSession, sf: str) -> DataFrame:
    return store.matching(records(spark, sf), classification="active_opportunity", keyword="health%grant").select("dedupe_key", "title")


def records_page(spark: SparkSession, sf: str) -> DataFrame:
    return store.listing(records(spark, sf), limit=50, offset=50).select("id", "source", "title", "dedupe_key")


def count_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return store.count_by_source(records(spark, sf))


def stats_by_classification(spark: SparkSession, sf: str) -> DataFrame:
    return store.statistics(records(spark, sf))


def delete_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_by_source(records(spark, sf), "sbir").select("dedupe_key", "source")


def _staged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A store of the records with even numbers, and two arrivals of each record divisible by 3 with changed columns."""
    rows = records(spark, sf).drop("source_raw", "ord")
    n = F.col("source_record_id").cast("long")
    arrivals = [rows.where(n % 3 == 0).withColumn("title", F.concat("title", F.lit(f" v{i}"))).withColumn("funding_type", F.lit(f"type{i}")).withColumn("_arrival", F.lit(i)) for i in (1, 2)]
    return rows.where(n % 2 == 0), arrivals[0].unionByName(arrivals[1])


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    target, staged = _staged(spark, sf)
    return store.upsert(target, staged, "dedupe_key", F.col("_arrival")).select("dedupe_key", "title", "funding_type")


def store_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert through the store's files, in a batch for each arrival."""
    target, staged = _staged(spark, sf)
    files = KeyedStore(spark, staging.own_folder(spark, "store"), buckets=16)
    for version, rows in enumerate((target, *(staged.where(F.col("_arrival") == i).drop("_arrival") for i in (1, 2)))):
        files.merge(rows, version, F.lit(0))
    return files.read().select("dedupe_key", "title", "funding_type")


def upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.upsert_counts(*_staged(spark, sf), "dedupe_key")


def dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.opportunities(spark, sf)
    return ranking.first_per_key(rows, [F.col("source"), F.substring("title", 1, 80)], F.col("ord")).select("id", "source", "title")


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.opportunities(spark, sf)
    text = F.concat_ws(" ", "title", "description")
    return rows.select("id", F.array_join(T.tokenize(text), " ").alias("tokens"), F.array_join(T.topic_tokens(text), " ").alias("topics"), T.norm_text(text).alias("norm"))


def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return analysis.term_counts(docs, "doc_id", T.topic_tokens(F.col("text")))


def synonym_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.opportunities(spark, sf).select("id", T.topic_tokens(F.concat_ws(" ", "title", "description")).alias("t"))
    return rows.select("id", F.size(T.expand_synonyms(F.col("t"))).cast("long").alias("n_expanded"), F.array_join(T.groups_present(F.col("t")), ",").alias("groups"))


def parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.lit("$"), F.format_number(n * 1234, 2))).when(n % 5 == 1, F.concat(n, F.lit(".6 USD"))).when(n % 5 == 2, "n/a").when(n % 5 == 3, F.concat(F.lit("-"), n)).otherwise(n.cast("string"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", raw.alias("raw")).select("doc_id", T.parse_amount(F.col("raw")).alias("ingest"), T.parse_live_amount(F.col("raw")).alias("live"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "opportunity.viewed").when(kind == "signup", "user.created").when(kind == "purchase", "opportunity.saved").when(kind == "click", "opportunity.applied").otherwise(kind)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.col("user_id").alias("source_user_id"), name.alias("event_type"), F.get_json_object("props", "$.k").alias("opp_id"), "value")


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_counts(_events(spark, sf))


def status_toggle(spark: SparkSession, sf: str) -> DataFrame:
    return ev.toggled_status(_events(spark, sf))


def latest_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("opp_id", F.struct("ts", "event_id").alias("ts"), F.when(F.col("value") > 20, "good").otherwise("weak").alias("label"))
    return ev.latest_labels(rows, ["opp_id"])


def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("total")
    ok = _scores(spark, sf).where("passes_eligibility")
    return ok.groupBy("org_id").agg(F.count_if(s >= 70).alias("excellent"), F.count_if((s >= 55) & (s < 70)).alias("strong"), F.count_if((s >= 38) & (s < 55)).alias("moderate"))


_ALL: tuple[Query, ...] = (
    v1_scores, v1_top10, v1_explained_top10, v1_capped_top, audit_scores, audit_weighted_variants, compare_v1_audit, compare_variants, sweep_funnel, sweep_histogram, sweep_by_source, sweep_types, dimension_avgs,
    risk_counts, upper_median, metrics_precision_recall, failure_classes, recommendations, active_filter, source_alias, expired_filter, pool_search, deterministic_id, ilike_search, records_page, count_by_source,
    stats_by_classification, delete_by_source, upsert_merge, store_batches, upsert_counts, dedupe_first_wins, tokenize_terms, top_terms, synonym_expand, parse_amount, event_counts, status_toggle, latest_label, tier_counts,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}
