"""DuckDB SQL for the specificity-first scorer's queries. Rows of the profile scorer give classes, tags, bands and boosts."""

from __future__ import annotations

from ..operators.scoring_v3 import CUES, DIMENSIONS, EXCLUDES, GENERIC, PENALTIES, PHRASES, POPULATIONS, SATISFIES
from ..operators.scoring_v4 import SUITS
from .oracle import _array
from .oracle_v2 import _V2, _any
from .oracle_v4 import _has, _listed, _norm

_TAGS = [p for level in POPULATIONS.values() for p in level]
_POINTED = _array(POPULATIONS[3] + POPULATIONS[4])
_ALL = _norm("mission || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(program_areas, ' ')")
_CORE = _norm("mission || ' ' || array_to_string(keywords, ' ')")


def _longest(found: str) -> str:
    return f"list_filter({found}, lambda t: len(list_filter({found}, lambda o: o <> t and contains(o, t))) = 0)"


def _by_class(table: dict[str, tuple[str, ...]]) -> str:
    return "(" + " or ".join(f"(class = '{c}' and list_has_any(elig, {_array(v)}))" for c, v in table.items()) + ")"


_INTENDED = "case " + " ".join(f"when {_any('ctext', *words)}" + (f" or type = '{kind}'" if kind else "") + f" then '{who}'" for who, words, kind in CUES) + " else 'open' end"
_LEVEL = "case " + " ".join(f"when list_has_any(sp, {_array(POPULATIONS[n])}) then {n}" for n in (4, 3, 2, 1)) + " end"
_V3 = (
    _V2 + f""",
o5a as (select id as oid, {_has(_ALL, PHRASES)} as oph, {_has(_CORE, PHRASES)} as core, string_split({_ALL}, ' ') as owords, {_has(_norm("mission || ' ' || array_to_string(population_served, ' ')"), _TAGS)} as raw from orgs),
o5 as (select oid, oph, core, owords, {_longest('raw')} as opops from o5a),
p5a as (select id as pid, type, lower(title || ' ' || description || ' ' || array_to_string(eligibility, ' ')) as ctext, {_norm('tt')} as fn, {_norm('title')} as tn, {_norm('description')} as bn, {_norm('substr(description, 1, 350)')} as opening,
    string_split({_norm("title || ' ' || description")}, ' ') as every, {_has(_norm("title || ' ' || substr(description, 1, 500)"), _TAGS)} as raw from p2),
p5 as (select pid, tn, bn, {_has('fn', PHRASES)} as ph, {_has('tn', PHRASES)} as tph, {_has('opening', PHRASES)} as oph2, list_filter(every, lambda t: length(t) > 2) as words, {_longest('raw')} as pops, {_INTENDED} as intended from p5a),
x5 as (select d2.org_id, d2.id, d2.ord, d2.source, d2.type, class, elig, cap, gap, budget, min_award, max_award, has_501c3, is_small, os, m, pm, d_a, d_c, d_g, d_f, boost, p5.*, o5.*,
    len(list_intersect(oph, ph)) as n_exact, list_filter(words, lambda t: list_contains(owords, t)) as mt, list_intersect(pops, opops) as sp, len(list_intersect(core, tph)) as th, len(list_intersect(core, oph2)) as oh,
    d2.type = 'procurement_contract' and class not in ('contractor', 'small_business', 'government') as bar1, d2.type = 'research_grant' and class not in ('university', 'research_institution') as bar2,
    {_listed('intended', {k: v[0] for k, v in SUITS.items()})} as good, {_listed('intended', {k: v[1] for k, v in SUITS.items()})} as bad,
    len(elig) = 0 or not ((list_contains(elig, '501c3') and not has_501c3 and class not in ('government', 'university', 'tribal')) or (list_has_all(['small_business', 'for_profit', '8a_certified', 'hubzone', 'sdvosb'], elig) and not is_small and class not in ('small_business', 'contractor'))
      or (list_has_any(elig, ['nonprofit', '501c3', 'community_based_org', 'community_org', 'ngo']) and not list_has_any(elig, ['for_profit', 'small_business', 'all']) and class not in ('nonprofit', 'tribal', 'research_institution', 'university', 'international_ngo'))
      or (list_has_all(['government', 'public_agency', 'state_government', 'local_government', 'federal_agency'], elig) and class not in ('government', 'tribal')) or {_by_class(EXCLUDES)}) as ok3
  from d2 join p5 on pid = d2.id join o5 on oid = d2.org_id),
y5 as (select *, case when len(mt) > 0 then len(list_filter(mt, lambda t: not list_contains({_array(GENERIC)}, t) and length(t) > 3))::double / len(mt) else 0.0::double end as ratio,
    case when n_exact >= 3 then 20 when n_exact = 2 then 16 when n_exact = 1 then 11 when len(oph) > 0 and len(ph) > 0 then 4 else 0 end + case when m >= 3 then 8 when m = 2 then 6 when m = 1 then 3 else 0 end as craw,
    case when th >= 2 then 6 when th = 1 then 4 when len(list_filter(os, lambda t: contains(tn, t))) > 0 then 2 else 0 end
      + greatest(case when oh >= 2 then 4 when oh = 1 then 2 else 0 end, case when len(core) > 0 and (length(bn) - length(replace(bn, core[1], ''))) / length(core[1]) >= 3 then 3 else 0 end) as cen from x5),
z5 as (select *, least(28, case when n_exact = 0 and ratio < 0.3 and craw > 3 then craw - 3 else craw end) as e1, least(12, cen) as e2, least(10, d_a) as e3,
    case when len(opops) > 0 and len(pops) > 0 then case when len(sp) > 0 then case {_LEVEL} when 4 then 7 + (len(sp) >= 2)::int when 3 then 5 + (len(sp) >= 2)::int when 2 then 3 + (len(sp) >= 2)::int else 2 end
      when len(list_filter(opops, lambda a: len(list_filter(pops, lambda b: contains(a, b) or contains(b, a))) > 0)) > 0 then 3 else 1 end when pm > 0 then 4 else 2 end as e4,
    case when bar1 then 3 when bar2 then case when class = 'nonprofit' then 5 else 3 end when good then case when intended = 'community_nonprofit' and class = 'nonprofit' then 12 when intended = 'open' then 8 else 10 end when bad then 3 else 6 end as e5,
    case when len(elig) = 0 then 6 when list_contains(elig, 'all') then 8 when {_by_class(SATISFIES)} then case when has_501c3 and list_contains(elig, '501c3') then 10 when is_small and list_has_any(elig, ['small_business', 'for_profit']) then 9 else 8 end else 5 end as e6,
    floor(d_g::double / 10 * 7 + 0.5)::bigint as e7, floor(d_c::double / 10 * 7 + 0.5)::bigint as e8, floor((case when max_award is null then 2 else d_f end)::double / 5 * 6 + 0.5)::bigint as e9 from y5),
b5 as (select *, e1 + e2 + e3 + e4 + e5 + e6 + e7 + e8 + e9 as base, floor(boost::double / 10 * 8 + 0.5)::bigint as sb from z5),
q5 as (select *, case when n_exact = 0 and ratio < 0.2 and base > 30 then least(15, floor(base * (1 - ratio) * 0.35::double + 0.5)::bigint) when n_exact = 0 and ratio < 0.35 then least(8, floor(base * (1 - ratio) * 0.15::double + 0.5)::bigint) else 0 end as f1,
    case when n_exact > 0 and e2 >= 4 then 0 when e1 >= 18 then 0 when e1 < 8 and e2 < 4 then 8 when e1 < 12 and e2 = 0 then 4 else 0 end as f2,
    case when bar1 then 10 when bar2 then case when class = 'nonprofit' then 5 else 8 end when good then 0 when bad then 8 else 0 end as f3,
    case when len(sp) = 0 and len(opops) > 0 and list_has_any(pops, {_POINTED}) then case when list_has_any(opops, {_POINTED}) then 6 else 3 end else 0 end as f4,
    floor(case when gap = 1 then 3 when gap = 2 then 7 when gap >= 3 then 10 else 0 end::double / 10 * 7 + 0.5)::bigint as f5,
    case when bar1 then 8 else 0 end as f6, case when source = 'ted_eu' and class not in ('contractor', 'small_business', 'government', 'university') then 4 else 0 end as f7, case when min_award > budget * 5 then 5 else 0 end as f8 from b5),
t5 as (select *, case when ok3 then greatest(0, least(100, base + sb - f1 - f2 - f3 - f4 - f5 - f6 - f7 - f8)) else 0 end::bigint as total from q5)"""
)


def oracle_sql() -> dict[str, str]:
    v3 = "with " + _V3 + " "
    dims = ", ".join(f"(case when ok3 then e{i} else 0 end)::bigint as {n}" for i, n in enumerate(DIMENSIONS, 1))
    penalty = " + ".join(f"f{i}" for i in range(1, 9))
    return {
        "v3_scores": v3 + f"select org_id, id, ok3 as passes_eligibility, {dims}, (case when ok3 then sb else 0 end)::bigint as semantic_boost, (case when ok3 then {penalty} else 0 end)::bigint as penalty_total, total from t5",
        "v3_top10": v3 + ", r as (select org_id, id, total, row_number() over (partition by org_id order by total desc, ord) as rank from t5 where ok3 and total > 0) select * from r where rank <= 10",
        "v3_penalties": v3 + "select org_id, type, sum(value)::bigint as value, count(*) as n from (" + " union all ".join(f"select org_id, '{n}' as type, f{i} as value from t5 where ok3 and f{i} > 0" for i, n in enumerate(PENALTIES, 1)) + ") group by org_id, type",
        "v3_sweep": v3 + "select org_id, count(*) as active, count(*) filter (not ok3) as ineligible, count(*) filter (ok3 and total = 0) as eligible_zero, count(*) filter (ok3 and total > 0) as scored, " + ", ".join(f"count(*) filter (ok3 and total > {n}) as above_{n}" for n in (30, 50, 70, 85)) + " from t5 group by org_id",
        "v3_phrases": v3 + "select pid as id, array_to_string(ph, ',') as phrases, intended, array_to_string(pops, ',') as populations from p5",
    }
