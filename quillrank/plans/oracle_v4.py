"""DuckDB SQL for the source-aware scorer's queries. Rows of the profile scorer give classes, tags, bands and boosts."""

from __future__ import annotations

from ..operators.scoring_v4 import CONCEPTS, GENERIC, POPULATIONS, REGIONS, SATISFIES, SOURCES, SUITS
from .oracle import _array
from .oracle_v2 import _V2, _any

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_POPS = [p for level in POPULATIONS.values() for p in level]


def _norm(x: str) -> str:
    return _NORM.format(x)


def _has(text: str, values: tuple[str, ...] | list[str]) -> str:
    return f"list_filter({_array(values)}, lambda q: contains({text}, q))"


def _pops(text: str) -> str:
    f = _has(text, _POPS)
    return f"list_filter({f}, lambda t: len(list_filter({f}, lambda o: o <> t and contains(o, t))) = 0)"


def _listed(column: str, table: dict[str, tuple[str, ...]]) -> str:
    return "(" + " or ".join(f"({column} = '{k}' and class in ({', '.join(repr(c) for c in v)}))" for k, v in table.items() if v) + ")"


def _level(tags: str) -> str:
    return "case " + " ".join(f"when list_has_any({tags}, {_array(POPULATIONS[n])}) then {n}" for n in (4, 3, 2, 1)) + " end"


_ALIAS = "case {0} " + " ".join(f"when '{k}' then {_array(v)}" for k, v in REGIONS.items()) + " else [{0}] end"
_REGIONS = "[" + ", ".join(f"{{'r': '{k}', 's': {_array(v)}}}" for k, v in REGIONS.items()) + "]"


def _within(a: str, b: str) -> str:
    return f"len(list_filter({_REGIONS}, lambda g: contains({a}, g.r) and len(list_filter(g.s, lambda z: contains({b}, z) or contains(z, {b}))) > 0)) > 0"


_NATIONAL = "(contains(pl, 'united states') or contains(pl, 'national') or contains(pl, 'nationwide') or pl in ('us', 'usa'))"
_IN_US = f"len(list_filter(oplaces, lambda g: contains(g, 'united states') or g in ('us', 'usa', 'national', 'nationwide') or len(list_filter({_array(list(REGIONS))}, lambda s: contains(g, s) or contains(s, g))) > 0)) > 0"
_V4 = (
    _V2 + f""",
o4 as (select id as oid, {_has(_norm("mission || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(program_areas, ' ')"), CONCEPTS)} as oph, string_split({_norm("mission || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(program_areas, ' ')")}, ' ') as owords,
    {_pops(_norm("mission || ' ' || array_to_string(population_served, ' ')"))} as opops, list_transform(geography, lambda g: {_norm('g')}) as oplaces from orgs),
p4a as (select id as pid, title, description, tt, type, eligibility, lower(title || ' ' || description || ' ' || array_to_string(eligibility, ' ')) as ctext, {_norm('tt')} as full_norm, {_norm('title')} as tn, {_norm('description')} as bn, geography, ord as n from p2),
p4 as (select *, {_has('full_norm', CONCEPTS)} as ph, {_has('tn', CONCEPTS)} as tph, {_has(_norm('substr(description, 1, 350)'), CONCEPTS)} as oph2, list_filter(string_split({_norm("title || ' ' || description")}, ' '), lambda t: length(t) > 2) as words,
    {_pops(_norm("title || ' ' || substr(description, 1, 500)"))} as pops, list_transform(geography, lambda g: {_norm('g')}) as places, array_to_string(list_transform(geography, lambda g: {_norm('g')}), ' ') as pl,
    case when n % 10 = 9 then 0 else case when 90 - n % 120 <= 14 then 3 when 90 - n % 120 <= 30 then 2 when 90 - n % 120 <= 60 then 1 else 0 end end as recency,
    case when {_any('ctext', 'hbcu', 'historically black college')} then 'hbcu_institution' when {_any('ctext', 'tribal college', 'tribal nation', 'native american')} then 'tribal'
      when type = 'procurement_contract' or {_any('ctext', 'vendor', 'contractor', 'solicitation', 'rfp', 'rfq')} then 'contractor' when {_any('ctext', 'government agency', 'public agency', 'local government', 'municipal')} then 'government'
      when {_any('ctext', 'small business', 'startup', 'entrepreneur', 'for-profit')} then 'small_business' when {_any('ctext', 'university', 'college', 'higher education', 'principal investigator')} or type = 'research_grant' then 'research_university'
      when {_any('ctext', 'community nonprofit', 'community-based', 'nonprofit organization', '501(c)(3)', 'community organization')} then 'community_nonprofit'
      when {_any('ctext', 'healthcare provider', 'health center', 'hospital', 'clinic', 'federally qualified')} then 'healthcare_provider' when {_any('ctext', 'nonprofit', 'ngo', 'charity', 'foundation')} then 'nonprofit' else 'open' end as intended from p4a),
x4 as (select d2.org_id, d2.id, d2.ord, d2.source, d2.type, class, elig, cap, gap, budget, min_award, max_award, has_501c3, is_small, os, op, pp, m, am, pm, d_a, d_c, boost, p4.* exclude (title, description, tt, type, eligibility, geography, n), o4.*,
    list_filter(oph, lambda q: list_contains(ph, q)) as exact, list_filter(words, lambda t: list_contains(owords, t)) as mt, list_intersect(pops, opops) as sp, len(list_filter(oph, lambda q: list_contains(tph, q))) as th, len(list_filter(oph, lambda q: list_contains(oph2, q))) as oh,
    d2.type = 'procurement_contract' and class not in ('contractor', 'small_business', 'government') as bar1, d2.type = 'research_grant' and class not in ('university', 'research_institution') as bar2,
    {_listed('intended', {k: v[0] for k, v in SUITS.items()})} as good, {_listed('intended', {k: v[1] for k, v in SUITS.items()})} as bad,
    len(elig) = 0 or not ((list_contains(elig, '501c3') and not has_501c3 and class not in ('government', 'university', 'tribal')) or (list_has_all(['small_business', 'for_profit', '8a_certified', 'hubzone', 'sdvosb'], elig) and not is_small and class not in ('small_business', 'contractor'))
      or (list_has_any(elig, ['nonprofit', '501c3', 'community_based_org', 'community_org', 'ngo']) and not list_has_any(elig, ['for_profit', 'small_business', 'all']) and class not in ('nonprofit', 'tribal', 'research_institution', 'university', 'international_ngo'))
      or (list_has_all(['government', 'public_agency', 'state_government', 'local_government', 'federal_agency'], elig) and class not in ('government', 'tribal'))) as ok4
  from d2 join p4 on pid = d2.id join o4 on oid = d2.org_id),
y4 as (select *, case when len(mt) > 0 then len(list_filter(mt, lambda t: not list_contains({_array(GENERIC)}, t) and length(t) > 3))::double / len(mt) else 0.0::double end as ratio,
    case when len(exact) >= 3 then 18 when len(exact) = 2 then 14 when len(exact) = 1 then 9 when len(oph) > 0 and len(ph) > 0 then 3 else 0 end + case when m >= 3 then 8 when m = 2 then 5 when m = 1 then 3 else 0 end as craw,
    case when th >= 2 then 5 when th = 1 then 4 when len(list_filter(os, lambda t: contains(tn, t))) > 0 then 2 else 0 end
      + greatest(case when oh >= 2 then 4 when oh = 1 then 2 else 0 end, case when len(oph) > 0 and (length(bn) - length(replace(bn, oph[1], ''))) / length(oph[1]) >= 3 then 3 else 0 end) as cen from x4),
z4 as (select *, least(26, case when len(exact) = 0 and ratio < 0.3 and craw > 3 then craw - 3 else craw end) as e1, least(10, cen) as e2, least(10, d_a) as e3,
    case when len(opops) > 0 and len(pops) > 0 then case when len(sp) > 0 then case {_level('sp')} when 4 then 7 + (len(sp) >= 2)::int when 3 then 5 + (len(sp) >= 2)::int when 2 then 3 + (len(sp) >= 2)::int else 2 end
      when len(list_filter(opops, lambda a: len(list_filter(pops, lambda b: contains(a, b) or contains(b, a))) > 0)) > 0 then 3 else 1 end when pm > 0 then 4 else 2 end as e4,
    case when bar1 then 3 when bar2 then case when class = 'nonprofit' then 5 else 3 end when good then case when intended = 'community_nonprofit' and class = 'nonprofit' then 12 when intended = 'open' then 8 else 10 end when bad then 3 else 6 end as e5,
    case when len(elig) = 0 then 6 when list_contains(elig, 'all') then 8 when {" or ".join(f"(class = '{c}' and list_has_any(elig, {_array(v)}))" for c, v in SATISFIES.items())}
      then case when has_501c3 and list_contains(elig, '501c3') then 10 when is_small and list_has_any(elig, ['small_business', 'for_profit']) then 9 else 8 end else 5 end as e6,
    case when len(places) = 0 or contains(pl, 'global') or contains(pl, 'international') then 5 when {_NATIONAL} then case when {_IN_US} then 8 else 2 end
      else coalesce(list_filter(flatten(list_transform(oplaces, lambda o: list_transform(places, lambda p: case when contains(o, p) or contains(p, o) or list_has_any({_ALIAS.format('o')}, {_ALIAS.format('p')}) then 8
        when {_within('o', 'p')} or {_within('p', 'o')} then 6 else 0 end))), lambda v: v > 0)[1], 0) end as e7,
    floor(d_c::double / 10 * 7 + 0.5)::bigint as e8,
    case when max_award is null and min_award is null then 3 when coalesce(max_award, min_award) >= budget * 0.1 and coalesce(min_award, 0) <= budget * 3.0 then 6 when coalesce(max_award, min_award) >= budget * 0.05 and coalesce(min_award, 0) <= budget * 5.0 then 4
      when coalesce(max_award, min_award) < budget * 0.05 then 2 when coalesce(min_award, 0) <= budget * 10.0 then 3 else 1 end as e9,
    case when {_listed('source', {k: v[0] for k, v in SOURCES.items()})} then 3 else 1 end as e10 from y4),
b4 as (select *, e1 + e2 + e3 + e4 + e5 + e6 + e7 + e8 + e9 + e10 as base, floor(boost::double / 10 * 8 + 0.5)::bigint as sb, len(exact) = 0 as none4 from z4),
q4 as (select *, case when none4 and ratio < 0.2 and base > 30 then least(15, floor(base * (1 - ratio) * 0.35::double + 0.5)::bigint) when none4 and ratio < 0.35 then least(8, floor(base * (1 - ratio) * 0.15::double + 0.5)::bigint) else 0 end as f1,
    case when none4 and e2 < 4 then case when e1 < 8 then 8 when e1 < 12 then 4 else 0 end else 0 end as f2, case when bar1 then 10 when bar2 then case when class = 'nonprofit' then 5 else 8 end when good then 0 when bad then 8 else 0 end as f3,
    case when len(sp) = 0 and len(opops) > 0 and len(pops) > 0 and list_has_any(pops, {_array(POPULATIONS[3] + POPULATIONS[4])}) then case when list_has_any(opops, {_array(POPULATIONS[3] + POPULATIONS[4])}) then 6 else 3 end else 0 end as f4,
    floor(case when gap = 1 then 3 when gap = 2 then 7 when gap >= 3 then 10 else 0 end::double / 10 * 7 + 0.5)::bigint as f5,
    case {" ".join(f"when source = '{s}' and class in ({', '.join(repr(c) for c in v[1])}) then {v[2]}" for s, v in SOURCES.items() if v[1])} else 0 end as f6, case when min_award > budget * 5 then 5 else 0 end as f7 from b4),
t4 as (select *, case when ok4 then greatest(0, least(100, base + sb + recency - f1 - f2 - f3 - f4 - f5 - f6 - f7)) else 0 end::bigint as total from q4)"""
)
_NAMES = ("concept_fit", "concept_centrality", "activity_fit", "population_fit", "target_applicant_fit", "eligibility", "geography_fit", "capacity_fit", "funding_fit", "source_relevance")
_PENALTIES = ("genericity", "weak_specificity", "target_applicant_mismatch", "population_mismatch", "complexity_mismatch", "source_barrier", "funding_capacity_mismatch")


def oracle_sql() -> dict[str, str]:
    v4 = "with " + _V4 + " "
    dims = ", ".join(f"(case when ok4 then e{i} else 0 end)::bigint as {n}" for i, n in enumerate(_NAMES, 1))
    return {
        "v4_scores": v4 + f"select org_id, id, ok4 as passes_eligibility, {dims}, (case when ok4 then sb else 0 end)::bigint as semantic_boost, (case when ok4 then recency else 0 end)::bigint as recency_boost, (case when ok4 then f1 + f2 + f3 + f4 + f5 + f6 + f7 else 0 end)::bigint as penalty_total, total, case when not ok4 then 'ineligible' when total >= 70 then 'excellent' when total >= 55 then 'strong' when total >= 38 then 'moderate' else 'weak' end as confidence from t4",
        "v4_capped_top10": v4 + ", live as (select t4.* from t4 join opps o on o.id = t4.id where ok4 and total >= 25 and (try_cast(close_date as date) is null or try_cast(close_date as date) >= date '2026-04-01')), c as (select *, row_number() over (partition by org_id, source order by total desc, ord) as n from live), f as (select org_id, id, source, total, row_number() over (partition by org_id order by total desc, ord) as rank from c where n <= 3) select * from f where rank <= 10",
        "v4_penalties": v4 + "select org_id, type, sum(value)::bigint as value, count(*) as n from (" + " union all ".join(f"select org_id, '{n}' as type, f{i} as value from t4 where ok4 and f{i} > 0" for i, n in enumerate(_PENALTIES, 1)) + ") group by org_id, type",
        "v4_sweep": v4 + "select org_id, count(*) as active, count(*) filter (not ok4) as ineligible, count(*) filter (ok4 and total = 0) as eligible_zero, count(*) filter (ok4 and total > 0) as scored, " + ", ".join(f"count(*) filter (ok4 and total > {n}) as above_{n}" for n in (30, 50, 70, 85)) + " from t4 group by org_id",
        "recency_boost": v4 + "select pid as id, recency::bigint as recency_boost from p4",
        "phrase_extract": v4 + "select pid as id, array_to_string(ph, ',') as phrases, intended from p4",
        "population_specificity": v4 + f"select pid as id, array_to_string(pops, ',') as populations, ({_level('pops')})::bigint as specificity from p4",
    }
