"""Queries of listings, reports, exports and coerced uploads, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..operators import ranking, reports, store
from ..operators import scoring_v1 as v1
from ..operators import scoring_v2 as v2
from ..operators import scoring_v4 as v4
from ..operators import scoring_v5 as v5
from ..sources import landed, uploads, views
from ..streaming import events as ev
from . import oracle, oracle_v2, oracle_v4, oracle_v5, queries_v2, queries_v4, queries_v5
from .queries import AS_OF, _audit, _events, _ranked, _scores, compare_v1_audit, recommendations, records, risk_counts


def audit_search(spark: SparkSession, sf: str) -> DataFrame:
    """A page of one source's rows whose title or agency holds the text, in the listing's own order."""
    scored = _audit(spark, sf).where("org_id = 'org_6'")
    found = reports.audit_search(scored, text="health").select("id", "source", "total", "ord")
    return ranking.page(found, reports.audit_order("total", "asc"), 20, 20).select("id", "source", "total")


def verbose_search(spark: SparkSession, sf: str) -> DataFrame:
    return reports.verbose_search(views.opportunities(spark, sf), "SBIR").select("id", "title", "source")


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The last event's status of each opportunity."""
    saved = ev.toggled_status(_events(spark, sf))
    last = saved.groupBy("opp_id").agg(F.max_by("status", "source_user_id").alias("status"))
    return last.withColumn("opp_id", F.concat(F.lit("doc_"), "opp_id"))


def _tabs(spark: SparkSession, sf: str) -> DataFrame:
    top = ranking.top_k(_scores(spark, sf), 20)
    return reports.with_status(top, _statuses(spark, sf), F.lit(AS_OF).cast("timestamp"), parse_date(F.col("close_date")))


def result_tabs(spark: SparkSession, sf: str) -> DataFrame:
    """The tabs that each ranked result is in."""
    tabs = F.array_compact(F.array(*[F.when(reports.in_tab(t), t) for t in ("all", "saved", "applied", "inactive")]))
    return _tabs(spark, sf).select("org_id", "id", F.array_join(tabs, ",").alias("tabs"))


def tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tab_counts(_tabs(spark, sf), "org_id")


def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.toggled_status(_events(spark, sf))
    return s.groupBy("source_user_id").agg(F.count_if(F.col("status") == "saved").alias("saved"), F.count_if(F.col("status") == "applied").alias("applied"))


def recently_viewed(spark: SparkSession, sf: str) -> DataFrame:
    viewed = _events(spark, sf).where("event_type = 'opportunity.viewed'")
    return ranking.page(viewed, [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "opp_id")


def matching_total(spark: SparkSession, sf: str) -> DataFrame:
    return store.matching(records(spark, sf), classification="active_opportunity", keyword="health").agg(F.count(F.lit(1)).alias("total"))


def pool_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: rows, different titles, and rows without a close date."""
    return views.opportunities(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.countDistinct("title").alias("unique_titles"), F.count_if(F.col("close_date").isNull()).alias("undated"))


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return views.opportunities(spark, sf).select("source").distinct()


def total_over_sources(spark: SparkSession, sf: str) -> DataFrame:
    return store.count_by_source(records(spark, sf)).agg(F.sum("n").alias("total"))


def playground_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.playground_stats(ranking.top_k(_scores(spark, sf), 50))


def ranked_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(_audit(spark, sf), 20).groupBy("org_id", "source", "funding_type").agg(F.count(F.lit(1)).alias("n"))


def comparison_flags(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flag_counts(compare_v1_audit(spark, sf))


def comparison_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare_v1_audit(spark, sf).where("org_id = 'org_6'")
    return ranking.page(rows, reports.comparison_order(), 12).select("opp_id", "rank_1", "rank_2", "flag")


def frequent_risks(spark: SparkSession, sf: str) -> DataFrame:
    return reports.most_frequent(risk_counts(spark, sf).groupBy("risk").agg(F.sum("n").alias("n")), "n", 8, "risk")


def ordered_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    rows = recommendations(spark, sf).select("priority", "category").distinct()
    return ranking.page(rows, reports.priority_order(), 3)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.run_metrics(queries_v4.best(spark, sf, True, cap=3), views.organizations(spark, sf))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = queries_v4._scores(spark, sf, drop_expired=True)
    return reports.run_report(scored, queries_v4.best(spark, sf, True, cap=3))


def unified_results(spark: SparkSession, sf: str) -> DataFrame:
    """The three best of each organization by four scorers, in one shape."""
    parts = (
        ("v1", ranking.top_k(_scores(spark, sf), 3), v1.DIMENSIONS),
        ("v2", queries_v2.best(spark, sf, 3), v2.DIMENSIONS),
        ("v4", queries_v4.best(spark, sf, k=3), v4.DIMENSIONS),
        ("v5", ranking.top_k(queries_v5._scores(spark, sf), 3), v5.DIMENSIONS),
    )
    out = None
    for version, ranked, dimensions in parts:
        part = reports.unified(ranked, version, dimensions)
        part = part.withColumn("dimensions", F.array_join(F.transform(F.array_sort(F.map_entries("dimensions")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))
        out = part if out is None else out.unionByName(part)
    return out


def csv_lines(ranked: DataFrame) -> DataFrame:
    top = v1.reasons_v1(ranked).withColumn("title", F.concat("title", F.lit(' "A"')))
    opp = {k: F.col(k) for k in ("title", "source", "agency", "close_date", "max_award", "url")}
    line = reports.csv_line(F.col("rank"), F.col("total"), F.when(F.col("total") >= 70, "excellent").otherwise("other"), opp, F.col("passes_eligibility"), F.lit("Open"), F.col("reasons"), F.col("risks"))
    return top.select("org_id", "rank", line.alias("line"))


def raw_csv_lines(ranked: DataFrame) -> DataFrame:
    top = ranked.withColumn("title", F.concat("title", F.lit(' "A"')))
    return top.select("org_id", "rank", reports.raw_csv_line(F.col("rank")).alias("line"))


def json_lines(ranked: DataFrame) -> DataFrame:
    return ranked.select("org_id", "rank", reports.json_line("rank", "total", "title", "source", "passes_eligibility").alias("line"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of each organization, which all exports hold."""
    return _ranked(spark, sf, 5)


def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    return csv_lines(listed(spark, sf))


def export_raw_csv(spark: SparkSession, sf: str) -> DataFrame:
    return raw_csv_lines(listed(spark, sf))


def export_json(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines(listed(spark, sf))


def displays(spark: SparkSession, sf: str) -> DataFrame:
    o = views.opportunities(spark, sf)
    return o.select("id", reports.shown_places(F.col("geography")).alias("places"), reports.shown_amount(F.col("max_award")).alias("amount"))


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON texts, whose geography is by turns an array with a null, JSON text, plain text, empty and missing."""
    o, n = views.opportunities(spark, sf), F.col("ord")
    place = F.when(n % 5 == 0, '["Ohio",null,"Texas"]').when(n % 5 == 1, '"[\\"Ohio\\", \\"Iowa\\"]"').when(n % 5 == 2, '"Ohio"').when(n % 5 == 3, '""').otherwise("null")
    tags = F.when(n % 3 == 0, '"energy"').otherwise('["energy","water"]')
    title = F.when(n % 7 == 0, "null").otherwise(F.concat(F.lit('"'), "title", F.lit('"')))
    text = F.concat(F.lit('{"id":"'), "id", F.lit('","source":"'), "source", F.lit('","title":'), title, F.lit(',"geography":'), place, F.lit(',"keywords":'), tags, F.lit(',"min_award":'), n.cast("string"), F.lit("}"))
    return o.select("ord", text.alias("payload"))


def coerced_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = uploads.coerce_opportunity(_payloads(spark, sf))
    plain = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("id", "source", "title", "funding_type", "status", "min_award", "max_award", plain("geography"), plain("keywords"), plain("categories"))


def coerced_profiles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 6 == 5, None).otherwise(
        F.concat(F.lit('{"'), F.when(k % 2 == 0, "name").otherwise("org_name"), F.lit('":"'), "n_name", F.lit('","program_areas":'), F.when(k % 3 == 0, '"health"').when(k % 3 == 1, '["a","b"]').otherwise("null"),
                 F.lit(',"annual_budget":'), F.when(k % 4 == 0, '"n/a"').otherwise((k * 1000).cast("string")), F.lit(',"has_501c3":'), F.when(k % 2 == 0, "true").otherwise("0"), F.lit("}"))
    )
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", text.alias("payload"))
    got = uploads.coerce_profile(rows, F.concat(F.lit("u"), "n_nationkey"))
    return got.select("id", "name", "org_type", F.array_join("program_areas", ",").alias("program_areas"), "annual_budget", "has_501c3", "is_small_business")


def _template(source: str) -> str:
    """A payload with the source's own first fields for id, title and largest award, each made of @N@."""
    out: dict = {}
    for name, value in (("id", "@N@"), ("title", "Title @N@"), ("max_award", "$@N@00")):
        path = next((x for x in landed.FIELDS[source][name] if not x.startswith("=")), None)
        keys = [path[2:-2]] if path and path.startswith("[") else path.split(".") if path else []
        at = out
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        if keys:
            at[keys[-1]] = value
    return json.dumps(out)


def normalized_records(spark: SparkSession, sf: str) -> DataFrame:
    """Landed payloads of all sources, one a document, as canonical records; every thirteenth has no id and is left out."""
    n = F.col("doc_id")
    source = F.element_at(F.array(*[F.lit(k) for k in landed.FIELDS]), (F.pmod(n, F.lit(len(landed.FIELDS))) + 1).cast("int"))
    text = F.element_at(F.create_map(*[F.lit(x) for k in landed.FIELDS for x in (k, _template(k))]), F.col("source"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", source.alias("source")).withColumn("payload", F.when(n % 13 == 12, "{}").otherwise(F.replace(text, F.lit("@N@"), n.cast("string"))))
    got = landed.normalize(rows.withColumn("landed_at", F.lit(AS_OF).cast("timestamp")))
    return got.select("source", "source_record_id", "classification", "title", "max_award", F.array_join("geography", ",").alias("geography"), "url", "dedupe_key")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by id: what a second save of a run changes and what it leaves."""
    n = F.col("ord")
    base = views.opportunities(spark, sf).select(F.concat(F.lit("run_"), n).alias("id"), "source", n.alias("n"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("total_updated", "total_skipped", "total_errors", "last_page")]
    none = [F.lit(None).cast("string").alias(c) for c in ("stop_reason", "error_message", "completed_at")]
    save = lambda rows, status, fetched, source: rows.select("id", source.alias("source"), F.lit(status).alias("status"), fetched.alias("total_fetched"), n.alias("total_inserted"), *zero, *none, F.lit(1).alias("_at")).drop("n")
    n = F.col("n")
    old = save(base.where("n % 2 = 0"), "running", n, F.col("source")).drop("_at")
    new = save(base.where("n % 3 = 0"), "completed", n * 10, F.lit("changed"))
    return store.upsert(old, new, "id", F.col("_at"), store.RUN_REFRESHED).select("id", "source", "status", "total_fetched")


def _normalized_sql() -> str:
    def one(i: int, source: str) -> str:
        f = landed.FIELDS[source]
        places = ",".join(f["geography"]) if isinstance(f["geography"], tuple) else f["geography"][-1][1:]
        url = next(u for u in f["url"] if u.startswith("="))[1:].replace("{url_id}", "{id}").replace("{id}", "' || doc_id || '")
        kind = "historical_intelligence" if source in ("usaspending", "nih_reporter", "nsf_awards") else "active_opportunity"
        most = "nullif(doc_id * 100, 0)" if f["max_award"] else "null::bigint"
        return f"select '{source}' as source, doc_id::varchar as source_record_id, '{kind}' as classification, 'Title ' || doc_id as title, {most} as max_award, '{places}' as geography, '{url}' as url, '{source}::' || doc_id as dedupe_key from documents where doc_id % {len(landed.FIELDS)} = {i} and doc_id % 13 <> 12"

    return " union all ".join(one(i, s) for i, s in enumerate(landed.FIELDS))


def queries() -> dict:
    every = (
        audit_search, verbose_search, result_tabs, tab_counts, dashboard_counts, recently_viewed, matching_total, pool_diagnostics, source_list, total_over_sources, playground_stats, ranked_by_source, comparison_flags, comparison_listing,
        frequent_risks, ordered_recommendations, run_metrics, run_report, unified_results, export_csv, export_raw_csv, export_json, displays, coerced_records, coerced_profiles, normalized_records, run_log,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    one, four = oracle.oracle_sql(), oracle_v4.oracle_sql()
    v1_, aud, opps, rec, ev_ = "with " + oracle._V1, "with " + oracle._PAIRS + "," + oracle._audit("v1_current"), "with " + oracle._OPPS, "with " + oracle._RECORDS, "with " + oracle._EVENTS
    toggled = one["status_toggle"].split("with ", 1)[1].replace("select source_user_id, opp_id, status from r qualify", "tog as (select source_user_id, opp_id, status from r qualify", 1).replace("and n % 2 = 1", "and n % 2 = 1)", 1)
    toggled = toggled.replace(" tog as (", ", tog as (", 1)
    tabs = v1_ + ", " + toggled + """, st as (select 'doc_' || opp_id as id, arg_max(status, source_user_id) as status from tog group by opp_id), tp as (select ranked.org_id, ranked.id, opps.close_date from ranked join opps using (id) where rank <= 20),
        tb as (select org_id, id, status, coalesce(try_cast(close_date as date) < date '2026-04-01', false) as expired from tp left join st using (id))"""
    compared = one["compare_v1_audit"]
    live = four["v4_capped_top10"].replace("and total >= 25 ", "and total > 0 ", 1)
    live_cte = live[: live.rindex("select * from f where rank <= 10")]
    entries = lambda names: " || ',' || ".join(f"'{k}=' || {e}" for k, e in sorted(names.items()))
    dims4 = {n: f"e{i}" for i, n in enumerate(oracle_v4._NAMES, 1) if n in v4.DIMENSIONS}
    v2_sql = oracle_v2.oracle_sql()["v2_scores"]
    return {
        "audit_search": aud + " select sa.id, sa.source, total from sa join opps on opps.id = sa.id where org_id = 'org_6' and (contains(lower(sa.title), 'health') or contains(lower('Agency ' || (sa.ord % 17)), 'health')) order by total desc, sa.ord limit 20 offset 20",
        "verbose_search": opps + " select id, title, source from opps where contains(lower(title), 'sbir') or contains(lower(source), 'sbir')",
        "result_tabs": tabs + " select org_id, id, concat_ws(',', case when not expired then 'all' end, case when not expired and status = 'saved' then 'saved' end, case when not expired and status = 'applied' then 'applied' end, case when expired then 'inactive' end) as tabs from tb",
        "tab_counts": tabs + " select org_id, count(*) filter (not expired) as all_open, count(*) filter (not expired and status = 'saved') as saved, count(*) filter (not expired and status = 'applied') as applied, count(*) filter (expired) as inactive from tb group by org_id",
        "dashboard_counts": "with " + toggled + " select source_user_id, count(*) filter (status = 'saved') as saved, count(*) filter (status = 'applied') as applied from tog group by source_user_id",
        "recently_viewed": ev_ + " select event_id, opp_id from ev where event_type = 'opportunity.viewed' order by ts desc, event_id desc limit 20",
        "matching_total": rec + " select count(*) as total from records where classification = 'active_opportunity' and title ilike '%health%'",
        "pool_diagnostics": opps + " select source, count(*) as fetched, count(distinct title) as unique_titles, count(*) filter (close_date is null) as undated from opps group by source",
        "source_list": opps + " select distinct source from opps",
        "total_over_sources": rec + " select count(*) as total from rec",
        "playground_stats": v1_ + " select org_id, count(*) as total_results, count(*) as eligible, count(*) filter (total >= 70) as above70, count(*) filter (total >= 50) as above50, floor(avg(total) + 0.5)::bigint as avg_score, max(total) as top_score from ranked where rank <= 50 group by org_id",
        "ranked_by_source": aud + " select org_id, source, funding_type, count(*) as n from ra where rank <= 20 group by all",
        "comparison_flags": f"select org_id, count(*) filter (flag = 'rose') as rose, count(*) filter (flag = 'fell') as fell, count(*) filter (flag = 'new') as new, count(*) filter (flag = 'stable') as stable from ({compared}) group by org_id",
        "comparison_listing": f"select opp_id, rank_1, rank_2, flag from ({compared}) where org_id = 'org_6' order by coalesce(rank_2, 999), coalesce(rank_1, 999), opp_id limit 12",
        "frequent_risks": f"select risk, sum(n)::bigint as n from ({one['risk_counts']}) group by risk order by n desc, risk limit 8",
        "ordered_recommendations": f"select priority, category from (select distinct priority, category from ({one['recommendations']})) order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, category limit 3",
        "run_metrics": live_cte + """select profiles, with_matches, no_match, avg_top, excellent, strong, sources, from_70, from_55, from_38, from_25, below_25 from
            (select count(*) as profiles, count(best) as with_matches, count(*) filter (best is null) as no_match, coalesce(floor(avg(best) + 0.5), 0)::bigint as avg_top, count(*) filter (best >= 70) as excellent, count(*) filter (best >= 55) as strong from orgs left join (select org_id, max(total) as best from f where rank <= 10 group by org_id) on org_id = orgs.id),
            (select count(distinct source) as sources, count(*) filter (total >= 70) as from_70, count(*) filter (total >= 55 and total < 70) as from_55, count(*) filter (total >= 38 and total < 55) as from_38, count(*) filter (total >= 25 and total < 38) as from_25, count(*) filter (total < 25) as below_25 from f where rank <= 10)""",
        "run_report": live_cte + """select * from (select t4.org_id, count(*) as scored, count(*) filter (ok4 and total > 0) as eligible, count(*) filter (total >= 70) as from_70, count(*) filter (total >= 55 and total < 70) as from_55, count(*) filter (total >= 38 and total < 55) as from_38, count(*) filter (total >= 25 and total < 38) as from_25, count(*) filter (total < 25) as below_25
            from t4 join opps o on o.id = t4.id where try_cast(close_date as date) is null or try_cast(close_date as date) >= date '2026-04-01' group by t4.org_id) left join (select org_id, count(*) as listed, count(distinct source) as sources, max(total) as best from f where rank <= 10 group by org_id) using (org_id)""",
        "unified_results": f"""select 'v1' as version, org_id, id, rank, total as score, case when total >= 70 then 'excellent' when total >= 50 then 'strong' when total >= 30 then 'moderate' else 'weak' end as confidence, true as eligible, {entries({d: d for d in v1.DIMENSIONS})} as dimensions from ({v1_} select * from ranked where rank <= 3)
            union all select 'v2', org_id, id, rank, total, case when total >= 70 then 'excellent' when total >= 50 then 'strong' when total >= 30 then 'moderate' else 'weak' end, true, {entries({d: d for d in v2.DIMENSIONS})} from (select *, row_number() over (partition by org_id order by total desc, cast(substr(id, 5) as bigint)) as rank from ({v2_sql}) where passes_eligibility and total > 0) where rank <= 3
            union all select 'v4', org_id, id, rank, total, case when total >= 70 then 'excellent' when total >= 55 then 'strong' when total >= 38 then 'moderate' else 'weak' end, true, {entries(dims4)} from (with {oracle_v4._V4} select *, row_number() over (partition by org_id order by total desc, ord) as rank from t4 where ok4 and total > 0) where rank <= 3
            union all select 'v5', org_id, id, rank, total, case when total >= 70 then 'excellent' when total >= 50 then 'strong' when total >= 30 then 'moderate' else 'weak' end, true, {entries({d: d for d in v5.DIMENSIONS})} from (with {oracle._OPPS}, {oracle._ORGS}, {oracle_v5.sql()} select *, row_number() over (partition by org_id order by total desc, ord) as rank from t5 where total > 0) where rank <= 3""",
        "export_csv": v1_ + f""", k as (select *, list_filter(org_keywords, lambda w: contains(lower(title || ' "A" ' || description || ' ' || array_to_string(keywords, ' ')), lower(w))) as kw from ranked where rank <= 5)
            select org_id, rank, rank || ',' || total || ',' || case when total >= 70 then 'excellent' else 'other' end || ',"' || replace(k.title || ' "A"', '"', '""') || '","' || k.source || '","Agency ' || (k.ord % 17) || '","' || coalesce(opps.close_date, '') || '","' || coalesce(k.max_award::varchar, '') || '","https://example.org/opportunities/' || k.ord || '",Yes,"Open","'
            || replace({oracle._REASONS}, '"', '""') || '","' || replace(array_to_string({oracle._RISKS}, ' | '), '"', '""') || '"' as line from k join (select id as oid, close_date from opps) opps on oid = k.id""",
        "export_raw_csv": v1_ + """ select org_id, rank, rank || ',"' || title || ' ''A''",' || source || ',"Agency ' || (ord % 17) || '",' || total || ',' || mission_topic_fit || ',' || eligibility_fit || ',' || geography_fit || ',' || funding_size_fit || ',' || maturity_fit || ',yes,https://example.org/opportunities/' || ord as line from ranked where rank <= 5""",
        "export_json": v1_ + """ select org_id, rank, '{"rank":' || rank || ',"total":' || total || ',"title":"' || title || '","source":"' || source || '","passes_eligibility":true}' as line from ranked where rank <= 5""",
        "displays": opps + " select id, case when len(geography) > 0 then array_to_string(geography[1:2], ', ') else '—' end as places, case when max_award <> 0 then '$' || format('{:,}', max_award) end as amount from opps",
        "coerced_records": opps + " select id, source, case when ord % 7 = 0 then 'Untitled' else title end as title, 'grant' as funding_type, 'active' as status, ord as min_award, null::bigint as max_award, case ord % 5 when 0 then 'Ohio,Texas' when 1 then 'Ohio,Iowa' when 2 then 'Ohio' else '' end as geography, case when ord % 3 = 0 then '' else 'energy,water' end as keywords, '' as categories from opps",
        "coerced_profiles": """select 'u' || n_nationkey as id, case when n_nationkey % 6 = 5 then 'My Organization' else n_name end as name, 'nonprofit' as org_type, case when n_nationkey % 6 = 5 then '' when n_nationkey % 3 = 0 then 'health' when n_nationkey % 3 = 1 then 'a,b' else '' end as program_areas,
            case when n_nationkey % 6 = 5 or n_nationkey % 4 = 0 then 0 else n_nationkey * 1000 end::double as annual_budget, n_nationkey % 6 <> 5 and n_nationkey % 2 = 0 as has_501c3, false as is_small_business from nation""",
        "normalized_records": _normalized_sql(),
        "run_log": opps + " select 'run_' || ord as id, case when ord % 2 = 0 then source else 'changed' end as source, case when ord % 3 = 0 then 'completed' else 'running' end as status, case when ord % 3 = 0 then ord * 10 else ord end as total_fetched from opps where ord % 2 = 0 or ord % 3 = 0",
    }
