"""Queries of the registry's state, the runs' log, live items, display texts, and the profile variant of the comparison, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ellipsis, first_language, strings
from ..operators import ranking, store
from ..operators import scoring_v1 as v1
from ..sources import landed, registry, views
from . import queries_v2
from .oracle import _OPPS, _array, _audit
from .oracle_v2 import hybrid_with

_RUN = registry.KEYS[:5]
_LIVE = ("SBIR/STTR", "Grants.gov", "TED EU")


def registry_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Every source with its records and the status of its last run; the last run of a source is that of its last record."""
    opps = views.opportunities(spark, sf)
    runs = opps.where(F.col("source").isin(*_RUN)).groupBy("source").agg(F.max_by(F.when(F.col("ord") % 2 == 0, "completed").otherwise("running"), "ord").alias("status"))
    return store.registry_status(registry.registry(spark), store.count_by_source(opps), runs).select("source", "name", "classification", "records", "run_status")


def latest_log(spark: SparkSession, sf: str) -> DataFrame:
    """The last 100 log lines of each source; the events stand for log lines."""
    n = F.col("event_id")
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.element_at(strings(registry.KEYS), (n % len(registry.KEYS) + 1).cast("int")).alias("source"), F.date_trunc("hour", "ts").alias("at"), n.alias("line_no"), F.col("event_type").alias("line"))
    return store.latest_lines(log).select("source", "line_no", "line")


def live_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    """Live items in the scoring schema: without id, title or url now and then."""
    n = F.col("doc_id")
    items = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.element_at(strings(_LIVE), (n % 3 + 1).cast("int")).alias("source_raw"),
        F.when(n % 4 != 0, n.cast("string")).alias("id"),
        F.when(n % 5 != 0, F.concat(F.lit("Item "), n)).alias("title"),
        F.col("text").alias("description"),
        F.col("source").alias("agency"),
        F.concat(F.lit("$"), "n_chars").alias("amount"),
        F.lit("2026-06-01").alias("deadline"),
        F.when(n % 7 != 0, F.concat(F.lit("https://example.org/"), n)).alias("url"),
    )
    return landed.live_items(items).select("id", "source", "source_raw", "title", "description", "agency", "close_date", F.col("max_award").cast("long").alias("max_award"), "url")


def ellipsized(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", ellipsis(F.col("text")).alias("shown"))


def first_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The text to show of those in several languages."""
    n, of = F.col("doc_id") % 4, lambda *langs: F.create_map(*[x for lang in langs for x in (F.lit(lang), F.concat(F.lit(f"{lang} "), F.col("doc_id")))])
    names = F.when(n == 0, of("deu", "fre", "eng")).when(n == 1, of("deu", "fre")).when(n == 2, of("ita", "deu")).otherwise(of("ita", "spa"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", first_language(names).alias("shown"))


def compare_profile_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best by the audit scorer beside the 20 best by profiles, which the variant v2_current stands for."""
    scored = v1.score_variants(v1.pairs(views.opportunities(spark, sf), views.organizations(spark, sf)), ("v1_current",))
    columns = ("variant", "org_id", F.col("id").alias("opp_id"), F.col("total").cast("long").alias("score"), "rank")
    keyword = ranking.top_k(scored, 20).select(*columns)
    profile = queries_v2.best_hybrid(spark, sf, 20).withColumn("variant", F.lit("v2_current")).select(*columns)
    return ranking.compare_named(keyword.unionByName(profile), ("v1_current", "v2_current"))


def queries() -> dict:
    return {q.__name__: q for q in (registry_progress, latest_log, live_opportunities, ellipsized, first_languages, compare_profile_variant)}


def oracle_sql() -> dict[str, str]:
    named = ", ".join(f"({', '.join(repr(x) for x in s[:3])})" for s in registry.SOURCES)
    pick = lambda name, column, least: f"coalesce(max({column}) filter (variant = '{name}'), {least}) as {column}_{name}"
    return {
        "registry_progress": f"with {_OPPS}, reg(source, name, classification) as (values {named}), n as (select source, count(*) as records from opps group by source), r as (select source, arg_max(case when ord % 2 = 0 then 'completed' else 'running' end, ord) as run_status from opps where source in ({', '.join(repr(k) for k in _RUN)}) group by source) select source, name, classification, coalesce(records, 0) as records, coalesce(run_status, 'idle') as run_status from reg left join n using (source) left join r using (source)",
        "latest_log": f"with l as (select ({_array(registry.KEYS)})[1 + event_id % {len(registry.KEYS)}] as source, date_trunc('hour', ts) as h, event_id as line_no, event_type as line from events) select source, line_no, line from l qualify row_number() over (partition by source order by h desc, line_no desc) <= 100",
        "live_opportunities": f"""with i as (select *, ({_array(_LIVE)})[1 + doc_id % 3] as source_raw, (['sbir', 'grants_gov', 'ted_eu'])[1 + doc_id % 3] as k, case when doc_id % 5 <> 0 then 'Item ' || doc_id end as t, case when doc_id % 7 <> 0 then 'https://example.org/' || doc_id end as u from documents)
            select k || '_' || case when doc_id % 4 <> 0 then doc_id::varchar else sha256(concat_ws('|', source_raw, t, text, u)) end as id, k as source, source_raw, coalesce(t, 'Untitled') as title, coalesce(text, '') as description, coalesce(source, '') as agency, '2026-06-01' as close_date, n_chars::bigint as max_award, coalesce(u, '') as url from i""",
        "ellipsized": "select doc_id, case when length(text) > 400 then substr(text, 1, 400) || '...' else text end as shown from documents",
        "first_languages": "select doc_id, (['eng ', 'fre ', 'deu ', 'ita '])[1 + doc_id % 4] || doc_id as shown from documents",
        "compare_profile_variant": hybrid_with() + "," + _audit("v1_current", "_v1_current") + f""", u as (select 'v1_current' as variant, org_id, id as opp_id, total as score, rank from ra_v1_current where rank <= 20 union all select 'v2_current', org_id, id, total, rank from hr where rank <= 20),
            w as (select org_id, opp_id, {', '.join(pick(n, c, least) for n in ('v1_current', 'v2_current') for c, least in (('score', 0), ('rank', 999)))}, max(rank) - min(rank) as rank_spread from u group by org_id, opp_id)
            select *, case when rank_v1_current = 999 and rank_v2_current < 999 then 'new' when rank_v2_current < rank_v1_current - 2 then 'rises' when rank_v2_current > rank_v1_current + 2 then 'falls' else 'stable' end as flag from w""",
    }
