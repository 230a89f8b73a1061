"""Sweeps of all versions with their best 50 rows, risk frequencies, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, explanations
from ..operators import scoring_hybrid as hybrid
from ..operators import scoring_v1 as v1
from ..operators import scoring_v3 as v3
from ..operators import scoring_v4 as v4
from ..operators.sweep import ABOVE, TYPES, sweep
from . import queries, queries_v2, queries_v3, queries_v4
from .explanation_queries import _RISKS_HYBRID, _RISKS_V3, _RISKS_V4
from .oracle_v2 import _V2, hybrid_with
from .oracle_v3 import _V3
from .oracle_v4 import _NAMES, _V4

_BOOSTS = {"v1": (), "hybrid": ("semantic_boost", "maturity_boost", "penalty_total"), "v3": ("semantic_boost", "penalty_total"), "v4": ("semantic_boost", "recency_boost", "penalty_total")}


def _flat(version: str, swept: DataFrame) -> DataFrame:
    """Lists as text, as SQL engines differ in nested types."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    sources = F.transform("by_source", lambda b: F.concat_ws("/", b["source"], *[b[n].cast("string") for n in ("total", "eligible", "scored", "avg_x100", "top")]))
    best = F.transform("best", lambda t: F.concat_ws("/", t["id"], t["total"].cast("string"), text(t["dimensions"])))
    lists = [F.array_join(text(n), ",").alias(n) for n in ("histogram", "types", "complexities", "dimension_tenths", "boosts")]
    return swept.select(F.lit(version).alias("version"), "org_id", "active", "ineligible", "eligible_zero", "scored", *[f"above_{n}" for n in ABOVE], *lists, F.array_join(sources, ",").alias("by_source"), F.array_join(best, ",").alias("best"))


def sweep_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep of each organization by four scorers, with the 50 best and their traces."""
    swept = {
        "v1": sweep(queries._scores(spark, sf), v1.DIMENSIONS, profiled=False),
        "hybrid": sweep(queries_v2._hybrid(spark, sf), hybrid.DIMENSIONS, _BOOSTS["hybrid"]),
        "v3": sweep(queries_v3._scores(spark, sf), v3.DIMENSIONS, _BOOSTS["v3"]),
        "v4": sweep(queries_v4._scores(spark, sf), v4.DIMENSIONS, _BOOSTS["v4"]),
    }
    return reduce(DataFrame.unionByName, [_flat(name, rows) for name, rows in swept.items()])


def hybrid_risks(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.risk_counts(explanations.reasons_hybrid(queries_v2._hybrid(spark, sf)))


def v3_risks(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.risk_counts(explanations.reasons_v3(queries_v3._scores(spark, sf)))


def v4_risks(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.risk_counts(explanations.reasons_v4(queries_v4._scores(spark, sf)))


def all_queries() -> dict:
    return {q.__name__: q for q in (sweep_versions, hybrid_risks, v3_risks, v4_risks)}


def _text(values: list[str]) -> str:
    return f"coalesce(array_to_string([{', '.join(values)}], ','), '')"


_ROWS = f"""
  select 'v1' as version, org_id, id, ord, source, ok, total, [{', '.join(v1.DIMENSIONS)}] as dims, []::bigint[] as boosts, null as type, null as cplx from s
  union all select 'hybrid', h.org_id, h.id, h.ord, h.source, passes_eligibility, h.total, [{', '.join(f'h.{d}' for d in hybrid.DIMENSIONS)}], [semantic_boost, maturity_boost, penalty_total], type, gap + cap from h join d2 using (org_id, id)
  union all select 'v3', org_id, id, ord, source, ok3, total, [{', '.join(f'e{i}' for i in range(1, 10))}], [sb, f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8], type, gap + cap from t5
  union all select 'v4', org_id, id, ord, source, ok4, total, [{', '.join(f'e{i}' for i in range(1, 1 + len(_NAMES)))}], [sb, recency, f1 + f2 + f3 + f4 + f5 + f6 + f7], type, gap + cap from t4"""


def _sweep_sql() -> str:
    hit = "filter (ok and total > 0)"
    count = lambda cond: f"count(*) filter (ok and total > 0 and {cond})"
    kinds = lambda values: f"case version when 'v1' then '' else {_text(values)} end"
    return hybrid_with() + _V3.removeprefix(_V2) + _V4.removeprefix(_V2) + f""", every as ({_ROWS}),
    g as (select version, org_id, count(*) as active, count(*) filter (not ok) as ineligible, count(*) filter (ok and total = 0) as eligible_zero, count(*) {hit} as scored, {', '.join(f'{count(f"total > {n}")} as above_{n}' for n in ABOVE)},
        {_text([count(f'least(9, (total - 1) // 10) = {i}') for i in range(10)])} as histogram, {kinds([count(f"type = '{t}'") for t in TYPES])} as types, {kinds([count(f'cplx = {i}') for i in range(4)])} as complexities,
        {_text([f'floor((sum(dims[{i}]) {hit})::double / nullif(count(*) {hit}, 0) * 10 + 0.5)::bigint' for i in range(1, 11)])} as dimension_tenths, {_text([f'case when len(any_value(boosts)) >= {i} then coalesce(sum(boosts[{i}]) {hit}, 0)::bigint end' for i in range(1, 4)])} as boosts from every group by version, org_id),
    b as (select version, org_id, source, count(*) as total, count(*) filter (ok) as eligible, count(*) {hit} as scored, coalesce(floor((sum(total) {hit})::double / nullif(count(*) {hit}, 0) * 100 + 0.5), 0)::bigint as mean, coalesce(max(total) {hit}, 0) as top from every group by version, org_id, source),
    b2 as (select version, org_id, string_agg(source || '/' || total || '/' || eligible || '/' || scored || '/' || mean || '/' || top, ',' order by source) as by_source from b group by version, org_id),
    k as (select *, row_number() over (partition by version, org_id order by total desc, ord) as n from every where ok and total > 0),
    k2 as (select version, org_id, string_agg(id || '/' || total || '/' || array_to_string(dims, '/'), ',' order by n) as best from k where n <= 50 group by version, org_id)
    select g.*, by_source, coalesce(best, '') as best from g join b2 using (version, org_id) left join k2 using (version, org_id)"""


def oracle_sql() -> dict[str, str]:
    counted = lambda risks, rows: f"select org_id, trim(regexp_replace(risk, '\\s*[—(].*$', '')) as risk, count(*) as n from (select org_id, unnest({risks}) as risk from {rows}) group by 1, 2"
    of_hybrid = "(select * from h where passes_eligibility and total > 0) h join (select org_id, id, class, type, cap, gap, min_award, budget, q1, q2, q3, q4, q5, q6 from d2) using (org_id, id) join (select id as org_id, years from orgs) using (org_id)"
    return {
        "sweep_versions": _sweep_sql(),
        "hybrid_risks": hybrid_with() + counted(_RISKS_HYBRID, of_hybrid),
        "v3_risks": "with " + _V3 + " " + counted(_RISKS_V3, "t5 where ok3 and total > 0"),
        "v4_risks": "with " + _V4 + " " + counted(_RISKS_V4, "t4 where ok4 and total > 0"),
    }
