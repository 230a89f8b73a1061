"""Queries that tell why the best opportunities of each organization scored as they did, by four scorers, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explanations
from ..operators.scoring_v4 import POPULATIONS
from . import queries_v2, queries_v3, queries_v4
from .oracle import _array
from .oracle_v2 import _V2, hybrid_with
from .oracle_v3 import _LEVEL, _V3
from .oracle_v3 import _POINTED as _POINTED_V3
from .oracle_v4 import _V4


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("org_id", "id", "rank", F.array_join("reasons", " | ").alias("reasons"), F.array_join("risks", " | ").alias("risks"))


def v2_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _told(explanations.reasons_v2(queries_v2.best(spark, sf)))


def hybrid_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _told(explanations.reasons_hybrid(queries_v2.best_hybrid(spark, sf)))


def v3_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _told(explanations.reasons_v3(queries_v3.best(spark, sf)))


def v4_explained_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _told(explanations.reasons_v4(queries_v4.best(spark, sf)))


def queries() -> dict:
    return {q.__name__: q for q in (v2_explained_top10, hybrid_explained_top10, v3_explained_top10, v4_explained_top10)}


def _lines(*cases: str) -> str:
    return "list_filter([" + ", ".join(f"case {c} end" for c in cases) + "], lambda x: x is not null)"


def _joined(lines: str) -> str:
    return f"array_to_string({lines}, ' | ')"


def _once(lines: str) -> str:
    """The lines without those said before."""
    return f"list_filter({lines}, lambda x, i: list_position({lines}, x) = i)"


_OWN, _WANTED = "(['early', 'growing', 'established', 'enterprise'])[1 + cap]", "(['low', 'medium', 'high', 'very_high'])[1 + gap + cap]"
_MIN = "format('{:,}', min_award::bigint)"
_FIT = "when {0} >= {1} then class || ' is a natural fit for ' || replace(type, '_', ' ') when {0} >= {2} then class || ' can competitively apply to ' || replace(type, '_', ' ')"
_V2_PENALTIES = (
    f"when q1 > 0 then 'Org capacity (' || {_OWN} || ') is below opportunity complexity (' || {_WANTED} || ')'",
    "when q2 > 0 then 'Procurement opportunity requires contracting infrastructure the org may lack'",
    "when q3 > 0 then 'Research grant typically requires scientific capacity not evident in this org profile'",
    "when q4 > 0 then 'Local/state-limited opportunity may not accept international organizations'",
    f"when q5 > 0 then 'Minimum award ($' || {_MIN} || ') may exceed org management capacity (budget: $' || format('{{:,}}', budget::bigint) || ')'",
    "when q6 > 0 then 'EU procurement may require business registration or local EU partner'",
    "when cap = 0 and gap + cap >= 2 then 'Early-stage org applying for a complex opportunity — build a strong narrative'",
)
_OUTSIDE = "when type = 'procurement_contract' and class not in ('contractor', 'small_business', 'government') then 'Procurement opportunities typically require {} and past performance documentation'"
_REASONS_V2 = _lines(
    "when d_e >= 17 then 'Strong eligibility — \"' || class || '\" is a primary applicant type' when d_e >= 12 then 'Meets eligibility requirements for this opportunity'",
    "when d_d >= 15 then 'Strong domain alignment: ' || array_to_string(list_filter(os, lambda t: list_contains(ps, t))[:3], ', ') when d_d >= 8 then 'Moderate domain overlap with opportunity focus areas'",
    _FIT.format("d_t", 9, 7),
    "when d_g >= 9 then 'Geography aligns with opportunity scope'",
    "when d_f >= 4 then 'Award size is realistic for this organization''s budget'",
    "when bo >= 5 then 'Multiple strong alignment signals detected across domains, activities, and populations'",
)
_RISKS_V2 = _lines(
    "when d_d = 0 then 'No domain tag overlap detected — verify mission relevance'",
    "when d_g <= 2 then 'Geographic scope may not match — verify eligibility before applying'",
    *_V2_PENALTIES,
    _OUTSIDE.format("registered SAM/DUNS"),
)
_REASONS_HYBRID = _lines(
    "when mission_domain >= 18 then 'Strong mission–opportunity alignment (' || mission_domain || '/25)' when mission_domain >= 10 then 'Moderate domain overlap (' || mission_domain || '/25)'",
    "when h.eligibility >= 17 then 'Confirmed eligibility for \"' || class || '\" org class' when h.eligibility >= 12 then 'Passes eligibility requirements'",
    _FIT.format("org_type_fit", 10, 7),
    "when geography_fit >= 9 then 'Geography aligns with opportunity scope'",
    "when capacity_fit >= 8 then 'Organizational capacity matches opportunity complexity'",
    "when funding_fit >= 6 then 'Award size is realistic for this organization''s budget'",
    "when semantic_boost >= 6 then 'Multiple strong alignment signals across domains, activities, and populations'",
    "when maturity_boost >= 3 then 'Track record of ' || years::bigint || ' years supports credibility'",
)
_RISKS_HYBRID = _lines(
    "when mission_domain <= 4 then 'Weak keyword and taxonomy overlap — verify mission relevance'",
    "when org_type_fit <= 3 then 'Org type may not be the primary applicant class for this opportunity'",
    "when geography_fit <= 2 then 'Geographic scope may not match — verify before applying'",
    "when capacity_fit <= 3 then 'Opportunity complexity may exceed current capacity — address in narrative'",
    "when funding_fit <= 2 then 'Funding size may be misaligned with organizational budget'",
    "when maturity_boost < 3 and years < 2 then 'Early-stage organization — strengthen narrative to compensate'",
    *_V2_PENALTIES,
    _OUTSIDE.format("SAM/DUNS registration"),
)
_MISMATCH = "case when bar1 then '{}' when bar2 then 'Research grants typically require PI credentials, IRB, and academic infrastructure' else 'Opportunity designed for \"' || replace(intended, '_', ' ') || '\" — org type may not be competitive' end"
_MISMATCH_V3 = _MISMATCH.format("Procurement opportunities require SAM/DUNS registration, past-performance documentation, and contractor experience")
_MISMATCH_V4 = _MISMATCH.format("Procurement requires SAM registration, past-performance documentation, and contractor experience")
_INTENDED = "when e5 >= 10 then '\"' || class || '\" is the intended applicant type'"
_ORG_CAPACITY = f"when f5 > 0 then 'Org capacity (' || {_OWN} || ') below opportunity complexity (' || {_WANTED} || ')'"
_MIN_AWARD = "> 0 then 'Min award ($' || " + _MIN + " || ') may exceed org management capacity'"


def _specific(tags: str, listed: str) -> str:
    return f"list_filter({tags}, lambda p: list_contains({listed}, p))[1]"


_APART = f"case f4 when 6 then 'Population mismatch: org serves ' || {_specific('opops', _POINTED_V3)} || ', opp targets ' || {_specific('pops', _POINTED_V3)} else 'Opp targets specific population (' || {_specific('pops', _POINTED_V3)} || ') not explicitly served by org' end"
_SHARED_PHRASES = "list_filter(oph, lambda q: list_contains(ph, q))"
_SHARED_POPS = "list_filter(pops, lambda q: list_contains(opops, q))"


def _exact(n: str, several: str) -> str:
    return f"when {n} >= 2 then {n} || '{several}' || array_to_string({_SHARED_PHRASES}[:2], ', ') when {n} = 1 then 'Exact concept match: \"' || {_SHARED_PHRASES}[1] || '\"'"


_REASONS_V3 = _lines(
    _exact("n_exact", " exact concept phrases match: "),
    "when e2 >= 6 then 'Core concept featured in opportunity title'",
    _INTENDED,
    f"when e4 >= 6 then 'Population match' || case when len(sp) > 1 then 'es' else '' end || ': ' || array_to_string({_SHARED_POPS}[:3], ', ') || ' (specificity ' || ({_LEVEL}) || '/4)'",
    "when e6 >= 9 then 'Strong eligibility confirmation'",
    "when sb >= 5 then 'Multi-signal alignment boost'",
)
_RISKS_V3 = _once(_lines(
    "when n_exact = 0 and ratio < 0.3 then 'Score driven by generic terms — verify mission relevance before applying'",
    "when e2 = 0 and e1 < 12 then 'Core concepts are not centrally featured in opportunity — may be a peripheral match'",
    f"when f3 > 5 then {_MISMATCH_V3}",
    f"when f4 > 0 then {_APART}",
    "when f1 > 0 then case when ratio < 0.2 and base > 30 then 'Score driven by generic terms (specificity ratio ' || floor(ratio * 100 + 0.5)::bigint || '%)' else 'Mostly generic overlap — weak specificity signal' end",
    "when f2 = 8 then 'Weak concept fit and low centrality — opportunity not centrally relevant to org mission' when f2 > 0 then 'No central concept connection found'",
    f"when f3 > 0 then {_MISMATCH_V3}",
    _ORG_CAPACITY,
    "when f6 > 0 then 'Procurement requires SAM registration and past performance'",
    "when f7 > 0 then 'EU procurement may require EU business registration or local partner'",
    "when f8 " + _MIN_AWARD,
))
_BARRIER = "case source when 'sbir' then 'SBIR/STTR is exclusively for small businesses — nonprofits and universities are not eligible' when 'sam_gov' then 'SAM.gov primarily lists federal procurement contracts requiring SAM registration and past performance' when 'ted_eu' then 'EU procurement requires EU business registration or local EU partner' when 'world_bank' then 'World Bank procurement typically requires international operations capability' when 'threesixtygiving' then '360Giving / UKRI awards philanthropic grants primarily to nonprofits and academic institutions' end"
_REASONS_V4 = _lines(
    _exact("len(exact)", " exact concept phrases: "),
    "when e2 >= 5 then 'Core concept featured in opportunity title'",
    _INTENDED,
    f"when len(sp) > 0 then 'Population match: ' || array_to_string({_SHARED_POPS}[:2], ', ')",
    "when e6 >= 9 then 'Strong eligibility confirmation'",
    "when e7 >= 7 then 'Geographic alignment confirmed'",
    "when sb >= 5 then 'Multi-signal alignment boost'",
    "when recency > 0 then 'Recently posted opportunity'",
)
_RISKS_V4 = _once(_lines(
    "when none4 and ratio < 0.3 then 'Score driven by generic terms — verify mission relevance'",
    f"when f3 > 5 then {_MISMATCH_V4}",
    "when f1 > 0 then case when ratio < 0.2 and base > 30 then 'Score driven by generic terms (specificity ' || floor(ratio * 100 + 0.5)::bigint || '%)' else 'Mostly generic overlap' end",
    "when f2 = 8 then 'Weak concept fit and low centrality' when f2 > 0 then 'No central concept connection found'",
    f"when f3 > 0 then {_MISMATCH_V4}",
    f"when f4 > 0 then 'Pop mismatch: org serves ' || opops[1] || ', opp targets ' || {_specific('pops', _array(POPULATIONS[3] + POPULATIONS[4]))}",
    _ORG_CAPACITY,
    f"when f6 > 0 then {_BARRIER}",
    "when f7 " + _MIN_AWARD,
))


def oracle_sql() -> dict[str, str]:
    best = lambda rows, ok: f", best as (select * from (select *, row_number() over (partition by org_id order by total desc, ord) as rank from {rows} where {ok} and total > 0) where rank <= 10) "
    told = lambda reasons, risks, rows="best": f"select org_id, id, rank, {_joined(reasons)} as reasons, {_joined(risks)} as risks from {rows}"
    of_hybrid = "(select * from hr where rank <= 10) h join (select org_id, id, class, type, cap, gap, min_award, budget, q1, q2, q3, q4, q5, q6 from d2) using (org_id, id) join (select id as org_id, years from orgs) using (org_id)"
    return {
        "v2_explained_top10": "with " + _V2 + " " + told(_REASONS_V2, _RISKS_V2, "r2 where rank <= 10"),
        "hybrid_explained_top10": hybrid_with() + told(_REASONS_HYBRID, _RISKS_HYBRID, of_hybrid),
        "v3_explained_top10": "with " + _V3 + best("t5", "ok3") + told(_REASONS_V3, _RISKS_V3),
        "v4_explained_top10": "with " + _V4 + best("t4", "ok4") + told(_REASONS_V4, _RISKS_V4),
    }
