"""DuckDB SQL for the profile scorer's queries."""

from __future__ import annotations

from ..functions.lexicons import ACTIVITIES, POPULATIONS, SECTORS
from ..operators.scoring_v2 import ALIASES, CLASSES, TYPE_FIT
from .oracle import _ACTIVE, _OPPS, _ORGS, _V1, _array


def _any(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _tags(text: str, lexicon: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {_any(text, *words)} then '{tag}' end" for tag, words in lexicon.items()) + "], lambda x: x is not null)"


def _scope(geo: str, world: str) -> str:
    t = f"lower(array_to_string({geo}, ' '))"
    return f"case when {_any(t, 'international', 'global', world)} then 'international' when {_any(t, 'national', 'united states', 'nationwide')} or {t} in ('us', 'usa') then 'national' when len({geo}) = 0 then 'unknown' when list_max(list_transform({geo}, lambda g: length(g))) > 2 then 'state' else 'local' end"


_FIT = "(case type " + " ".join(f"when '{k}' then [{', '.join(map(str, row))}]" for k, row in TYPE_FIT.items()) + f" end)[list_position({_array(CLASSES)}, class)]"
_ALIAS = " or ".join(f"(class = '{c}' and list_has_any(elig, {_array(v)}))" for c, v in ALIASES.items())
_V2 = (
    _OPPS + "," + _ORGS + f""",
o1 as (select *, lower(mission || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(program_areas, ' ')) as ct, lower(mission || ' ' || array_to_string(program_areas, ' ') || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(population_served, ' ')) as tt from orgs),
o2 as (select *, case when org_type in ('small_business', 'university') then org_type
    when org_type in ('government', 'nonprofit') and {_any('ct', 'tribal', 'native american', 'indigenous')} then 'tribal' when org_type = 'government' then 'government'
    when org_type = 'nonprofit' and ({_any('ct', 'research', 'science', 'lab')} or list_contains(keywords, 'study')) then 'research_institution'
    when org_type = 'nonprofit' and {_any('ct', 'international', 'global', 'overseas')} then 'international_ngo' when org_type = 'nonprofit' then 'nonprofit'
    when {_any('ct', 'tribal', 'native american')} then 'tribal' when {_any('ct', 'university', 'college', 'academic')} then 'university' when {_any('ct', 'contract', 'consulting firm', 'professional services')} then 'contractor'
    when {_any('ct', 'international', 'global', 'overseas')} then 'international_ngo' else 'other' end as class,
    {_tags('tt', SECTORS)} as os, {_tags('tt', ACTIVITIES)} as oa, {_tags("lower(mission || ' ' || array_to_string(population_served, ' '))", POPULATIONS)} as op, {_scope('geography', 'overseas')} as oscope,
    greatest((budget >= 1e5)::int + (budget >= 5e5)::int + (budget >= 5e6)::int, (years >= 2)::int + (years >= 5)::int + (years >= 15)::int) as cap from o1),
o3 as (select *, case when class = 'contractor' then 'high' when (is_small or class = 'government') and cap <> 0 then 'medium' else 'low' end as proc,
    case when class in ('research_institution', 'university') then 'high' when list_has_any(keywords, ['research', 'science', 'lab', 'study', 'data', 'analysis']) then 'medium' else 'low' end as res from o2),
p1 as (select *, lower(title || ' ' || description) as b, lower(title || ' ' || description || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(categories, ' ')) as tt from opps),
p2 as (select *, case when source in ('sam_gov', 'ted_eu') then 'procurement_contract' when source = 'sbir' then 'research_grant'
    when source = 'world_bank' then case when {_any('b', 'procurement', 'contract')} then 'procurement_contract' else 'international_implementation' end
    when funding_type in ('contract', 'procurement') then 'procurement_contract' when {_any('b', 'prize', 'challenge', 'competition')} then 'prize_challenge' when {_any('b', 'fellowship', 'internship')} then 'fellowship_training'
    when {_any('b', 'research', 'laboratory', 'scientific study', 'clinical study')} then 'research_grant' when {_any('b', 'infrastructure', 'capital project', 'construction')} then 'infrastructure_capital'
    when {_any('b', 'international', 'overseas', 'global development')} then 'international_implementation' when {_any('b', 'technical assistance', ' ta ')} then 'technical_assistance'
    when contains(b, 'capacity') and contains(b, 'build') then 'capacity_building_grant' when {_any('b', 'planning', 'feasibility', 'assessment')} then 'planning_grant'
    when contains(b, 'training') and not contains(b, 'workforce') then 'fellowship_training' when {_any('b', 'procurement', 'solicitation', 'rfp')} then 'procurement_contract' else 'program_service_grant' end as type,
    {_tags('tt', SECTORS)} as ps, {_tags('tt', ACTIVITIES)} as pa, {_tags('tt', POPULATIONS)} as pp, eligibility as elig, {_scope('geography', 'worldwide')} as scope, coalesce(max_award, min_award) as amount from p1),
p3 as (select *, (select count(*) from (values (2), (4), (6)) v(lim) where pts >= lim) as cplx from (select *,
    case when type in ('procurement_contract', 'infrastructure_capital') then 3 when type in ('research_grant', 'international_implementation') then 2 else 0 end
    + case when amount >= 10000000 then 3 when amount >= 1000000 then 2 when amount >= 150000 then 1 else 0 end + 2 * {_any('b', 'prior federal', 'past performance')}::int + {_any('b', 'cooperative agreement', 'multi-site')}::int
    + {_any('b', 'international', 'overseas')}::int + {_any('b', 'compliance', 'reporting requirements')}::int + {_any('b', 'environmental review', 'audit')}::int as pts from p2)),
x2 as (select o3.id as org_id, p3.id, ord, source, type, class, elig, cplx, cap, scope, oscope, proc, res, budget, min_award, max_award, has_501c3, is_small, os, oa, op, ps, pa, pp, list_transform(o3.geography, lambda g: lower(g)) as og, list_transform(p3.geography, lambda g: lower(g)) as pg,
    len(list_intersect(os, ps)) as m, len(list_intersect(oa, pa)) as am, len(list_intersect(op, pp)) as pm, cplx - cap as gap,
    len(elig) = 0 or not ((list_has_any(elig, ['nonprofit', '501c3', 'community_based_org', 'community_org']) and not list_has_any(elig, ['for_profit', 'small_business', 'all']) and class not in ('nonprofit', 'tribal', 'research_institution', 'university'))
      or (list_has_all(['small_business', 'for_profit', '8a_certified'], elig) and not is_small and class not in ('small_business', 'contractor')) or (list_contains(elig, '501c3') and not has_501c3 and class not in ('government', 'university', 'tribal'))) as ok
  from p3 cross join o3 where source in ({_ACTIVE})),
d2 as (select *, case when len(elig) = 0 then 12 when list_contains(elig, 'all') then 15 else least(20, 12 + 5 * ({_ALIAS})::int + 2 * (has_501c3 and list_contains(elig, '501c3'))::int + (is_small and list_has_any(elig, ['small_business', 'for_profit']))::int) end as d_e,
    case when len(os) = 0 and len(ps) = 0 then 8 when len(os) = 0 or len(ps) = 0 then 6 when m = 0 then 0 when m >= 4 then 20 when m = 3 then 17
      else floor(case m when 2 then 12 else 8 end + m::double / len(list_distinct(os || ps)) * 8 + 0.5)::bigint end as d_d,
    case when len(oa) = 0 or len(pa) = 0 then 6 when am = 0 then 2 when am >= 3 then 15 when am = 2 then 11 else 7 end as d_a, case when len(op) = 0 or len(pp) = 0 then 5 when pm = 0 then 2 when pm >= 2 then 10 else 6 end as d_p,
    case when scope in ('international', 'unknown') then 7 when scope = 'national' and oscope in ('national', 'state', 'local') then 10 when scope = 'national' and oscope = 'international' then 5
      when len(pg) > 0 and len(og) > 0 then case when len(list_filter(og, lambda a: len(list_filter(pg, lambda b: contains(a, b) or contains(b, a))) > 0)) > 0 then 10 else 2 end when scope = oscope then 9 else 5 end as d_g,
    {_FIT} as d_t, case when gap <= 0 then 10 when gap = 1 then 6 when gap = 2 then 3 else 1 end as d_c,
    case when max_award is null then 3 when max_award >= budget * 0.05 and coalesce(min_award, 0) <= budget * 3.0 then 5 when max_award >= budget * 0.05 * 0.4 and coalesce(min_award, 0) <= budget * 3.0 * 2 then 3
      when max_award < budget * 0.01 or coalesce(min_award, 0) > budget * 5 then 1 else 2 end as d_f,
    least(10, case when m >= 4 then 4 when m >= 2 then m else 0 end + least(2, pm) + least(2, am) + 2 * (has_501c3 and list_contains(elig, '501c3'))::int + 2 * (is_small and list_has_any(elig, ['small_business', 'for_profit']))::int) as boost,
    case when gap = 1 then 3 when gap = 2 then 7 when gap >= 3 then 10 else 0 end as q1, 8 * (type = 'procurement_contract' and proc = 'low' and class not in ('government', 'contractor', 'small_business'))::int as q2,
    5 * (type = 'research_grant' and res = 'low' and class not in ('university', 'research_institution'))::int as q3, 5 * (scope in ('local', 'state') and oscope = 'international')::int as q4,
    5 * coalesce(min_award > budget * 5, false)::int as q5, 5 * (source = 'ted_eu' and class not in ('contractor', 'small_business', 'government', 'university'))::int as q6 from x2),
s2 as (select *, case when ok then d_e + d_d + d_a + d_p + d_g + d_t + d_c + d_f else 0 end as base, case when ok then q1 + q2 + q3 + q4 + q5 + q6 else 0 end as pen, case when ok then boost else 0 end as bo from d2),
t2 as (select *, greatest(0, least(100, base + bo - pen)) as total from s2),
r2 as (select *, row_number() over (partition by org_id order by total desc, ord) as rank from t2 where ok and total > 0)"""
)
_NAMES = {"eligibility_fit": "d_e", "domain_fit": "d_d", "activity_fit": "d_a", "population_fit": "d_p", "geography_fit": "d_g", "organization_type_fit": "d_t", "capacity_fit": "d_c", "funding_fit": "d_f"}
_BAND = "(['early', 'growing', 'established', 'enterprise'])[1 + cap]"


def oracle_sql() -> dict[str, str]:
    v2 = "with " + _V2 + " "
    dims = ", ".join(f"(case when ok then {c} else 0 end)::bigint as {n}" for n, c in _NAMES.items())
    return {
        "v2_scores": v2 + f"select org_id, id, ok as passes_eligibility, {dims}, base::bigint as base_score, bo::bigint as semantic_boost, pen::bigint as penalty_total, total::bigint as total from t2",
        "v2_top10": v2 + "select org_id, id, total::bigint as total, rank from r2 where rank <= 10",
        "v2_sweep": v2 + "select org_id, count(*) as active, count(*) filter (not ok) as ineligible, count(*) filter (ok and total = 0) as eligible_zero, count(*) filter (ok and total > 0) as scored, " + ", ".join(f"count(*) filter (ok and total > {n}) as above_{n}" for n in (30, 50, 70, 85)) + " from t2 group by org_id",
        "sector_tags": v2 + "select id, array_to_string(ps, ',') as sectors from p3",
        "activity_tags": v2 + "select id, array_to_string(pa, ',') as activities from p3",
        "population_tags": v2 + "select id, array_to_string(pp, ',') as populations from p3",
        "opportunity_type": v2 + "select id, type from p3",
        "complexity_band": v2 + "select id, (['low', 'medium', 'high', 'very_high'])[1 + cplx] as complexity, case when amount is null then null when amount < 25000 then 'micro' when amount < 150000 then 'small' when amount < 1000000 then 'medium' when amount < 10000000 then 'large' else 'enterprise' end as funding_band from p3",
        "capacity_band": v2 + f"select id, class, {_BAND} as capacity, oscope as scope, proc as procurement_readiness, res as research_readiness from o3",
        "penalty_sum": v2 + "select org_id, type, sum(value)::bigint as value, count(*) as n from (" + " union all ".join(f"select org_id, '{n}' as type, q{i} as value from d2 where ok and q{i} > 0" for i, n in enumerate(("complexity_mismatch", "procurement_mismatch", "research_mismatch", "geography_scope_mismatch", "funding_capacity_mismatch", "eu_procurement_barrier"), 1)) + ") group by org_id, type",
    }


def hybrid_with() -> str:
    """The hybrid scorer's rows `h` and their ranks `hr`, from the rows of both scorers."""
    bonus = "(case when list_contains(y.elig, org_type) then 5 else 0 end + case when y.has_501c3 and list_contains(y.elig, '501c3') then 3 else 0 end + case when y.is_small and list_contains(y.elig, 'small_business') then 2 else 0 end)"
    return "with " + _V1 + "," + _V2.removeprefix(_OPPS + "," + _ORGS + ",") + f""",
    h1 as (select y.org_id, y.id, y.ord, y.source, d2.ok as ok2, d_d, d_a, d_p, d_g, d_t, d_c, d_f, boost, q1 + q2 + q3 + q4 + q5 + q6 as pen, case when d2.ok then d_e else 0 end as e2,
        floor(least(60.0::double, hits::double / least(uniq, 20) * 60 + case when hits > 0 then 8 else 0 end) + 0.5) as k1,
        case when not y.ok then 0 when len(y.elig) = 0 then 10 else least(20, 10 + {bonus}) end as e1, case geo when 'open' then 7 when 'match' then 10 else 0 end as g1,
        case fund when 'unknown' then 3 when 'ideal' then 5 when 'near' then 3 when 'partial' then 2 else 1 end as f1,
        case when years >= 5 then 5 when years >= 3 then case when wants then 3 else 4 end when years >= 1 then case when wants then 2 else 3 end else 1 end as m1
      from y join d2 using (org_id, id)),
    h2 as (select *, e1 > 0 or ok2 as ok from h1),
    h3 as (select org_id, id, ord, source, ok as passes_eligibility,
        (case when ok then floor(0.6::double * (k1 / 60) * 25 + 0.4::double * (d_d::double / 20) * 25 + 0.5) else 0 end)::bigint as mission_domain, (case when ok then least(20, greatest(e1, e2)) else 0 end)::bigint as eligibility,
        (case when ok then floor(d_t::double / 10 * 12 + 0.5) else 0 end)::bigint as org_type_fit, (case when ok then floor(d_a::double / 15 * 10 + 0.5) else 0 end)::bigint as activity_fit,
        (case when ok then floor(0.5::double * g1 + 0.5::double * d_g + 0.5) else 0 end)::bigint as geography_fit, (case when ok then d_c else 0 end)::bigint as capacity_fit,
        (case when ok then floor(0.5::double * (f1::double / 5) * 8 + 0.5::double * (d_f::double / 5) * 8 + 0.5) else 0 end)::bigint as funding_fit, (case when ok then floor(d_p::double / 10 * 5 + 0.5) else 0 end)::bigint as population_fit,
        (case when ok then boost else 0 end)::bigint as semantic_boost, (case when ok then floor(m1::double / 5 * 4 + 0.5) else 0 end)::bigint as maturity_boost, (case when ok then pen else 0 end)::bigint as penalty_total from h2),
    h as (select *, greatest(0, least(100, mission_domain + eligibility + org_type_fit + activity_fit + geography_fit + capacity_fit + funding_fit + population_fit + semantic_boost + maturity_boost - penalty_total)) as total from h3),
    hr as (select *, row_number() over (partition by org_id order by total desc, ord) as rank from h where passes_eligibility and total > 0) """


def hybrid_sql() -> dict[str, str]:
    hybrid = hybrid_with()
    return {
        "hybrid_scores": hybrid + "select * exclude (ord, source) from h",
        "hybrid_top10": hybrid + "select org_id, id, total, rank from hr where rank <= 10",
        "hybrid_capped_top": hybrid + ", c as (select *, row_number() over (partition by org_id, source order by total desc, ord) as n from hr), f as (select org_id, id, source, total, row_number() over (partition by org_id order by total desc, ord) as rank from c where n <= 3) select * from f where rank <= 10",
        "hybrid_histogram": hybrid + "select org_id, bin::int as bin, count(*) filter (passes_eligibility and total > 0 and least(9, (total - 1) // 10) = bin) as n from h cross join range(10) b(bin) group by org_id, bin",
    }
