"""DuckDB SQL for the title-first scorer's queries, by list comprehensions over the same fixed tables."""

from __future__ import annotations

import math

from ..operators import scoring_v5 as v5
from . import interpretation_queries
from .oracle import _ACTIVE, _OPPS, _ORGS, _array
from .oracle_v4 import _V4
from .queries_v5 import TITLE_HEAVY

_OR = " or "


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-–—]', ' ', 'g'), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g'))"


def _stem(w: str) -> str:
    return (
        f"(case when length({w}) < 5 then {w} when ({w} like '%ies' or {w} like '%ied') and length({w}) > 5 then {w}[:-4] || 'y' when {w} like '%ing' and length({w}) > 6 then {w}[:-4] when ({w} like '%tion' or {w} like '%ness' or {w} like '%ment') and length({w}) > 6 then {w}[:-5]"
        f" when {w} like '%al' and length({w}) > 5 then {w}[:-3] when {w} like '%ers' and length({w}) > 5 then {w}[:-2] when {w} like '%es' and length({w}) > 4 then {w}[:-3] when {w} like '%s' and length({w}) > 4 then {w}[:-2] else {w} end)"
    )


def _in(w: str, values: list[str]) -> str:
    return f"list_contains({_array(values)}, {w})"


def _kept(items: str) -> str:
    return f"list_filter({items}, lambda z: z is not null)"


def _ordered(column: str) -> str:
    """The distinct elements of a list column, in the order of their first occurrence."""
    return f"list_transform(list_filter(list_transform(range(1, len({column}) + 1), lambda i: {{'i': i, 'v': {column}[i]}}), lambda x: list_position({column}, x.v) = x.i), lambda x: x.v)"


_NEAR_WORDS = f"list_filter(string_split(y.p, ' '), lambda w: length(w) > 2 and not {_in('w', v5.CONNECTORS)})"
_HITS = f"len(list_filter({_NEAR_WORDS}, lambda w: list_contains(ta, w) or list_contains(ts, {_stem('w')})))"
_NEAR = f"(len({_NEAR_WORDS}) >= 2 and {_HITS} >= case when len({_NEAR_WORDS}) = 2 then 2 else ceil(len({_NEAR_WORDS}) * 0.75) end)"
_WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(mission), '[^a-z\s''-]', ' ', 'g'), '[''-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 1)"
_LONG = lambda w: f"(length({w}) > 3 and not {_in(w, v5.GENERIC)})::int"
_ALLGEN = rf"len(list_filter(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 1), lambda w: not {_in('w', v5.GENERIC)})) = 0 and len(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 1)) > 0"


def _sourced(texts: str, source: str) -> str:
    return f"list_transform(list_filter({texts}, lambda t: length(t) > 2 and not ({_ALLGEN})), lambda t: {{'p': {_norm('t')}, 's': '{source}'}})"


_GROUPS = {p: [v5.plain_phrase(s) for s in group if s != p] for group in v5.SYNONYMS for p in group}
_SIBLINGS = "(case {0} " + " ".join(f"when {_q(p)} then {_array(s)}" for p, s in _GROUPS.items() if p == v5.plain_phrase(p)) + " else []::varchar[] end)"
_TRIM = lambda a: f"list_transform({a}, lambda t: trim(lower(t)))"
_PHRASES = ", ".join(f"{{'p': {_q(p)}, 'w': {_array([w for w in v5.plain_phrase(p).split() if len(w) > 3 and w not in v5.GENERIC])}}}" for p in v5.MISSION_PHRASES)


def _global(p: str, weight: int) -> str:
    n, most = v5.plain_phrase(p), 1 if weight >= 16 else 0.7
    words = [w for w in n.split() if len(w) > 2 and w not in v5.CONNECTORS]
    near = [f"contains(tn, {_q(s)})" for s in _GROUPS.get(n, [])]
    if len(words) >= 2:
        near.append("(" + " + ".join(f"(list_contains(ta, {_q(w)}) or list_contains(ts, {_q(v5.plain_stem(w))}))::int" for w in words) + f") >= {2 if len(words) == 2 else math.ceil(len(words) * 0.75)}")
    row = lambda x, v: f"{{'p': {_q(p)}, 'n': {_q(n)}, 'x': {x}, 'v': {math.floor(v + 0.5)}}}"
    return f"case when contains(tn, {_q(n)}) then {row('true', 14 * most)} when {_OR.join(near) or 'false'} then {row('false', 7 * most)} end"


_VARIANTS: dict[str, tuple[str, ...]] = {}
_BACK: dict[str, list[str]] = {}
for _name, _others in v5.VARIANTS:
    _VARIANTS.setdefault(v5.plain_phrase(_name), tuple(map(v5.plain_phrase, _others)))
    for _v in dict.fromkeys(map(v5.plain_phrase, _others)):
        _BACK.setdefault(_v, []).append(v5.plain_phrase(_name))
_VAR = "(case {0} " + " ".join(f"when {_q(k)} then {_array(v)}" for k, v in _VARIANTS.items()) + " else []::varchar[] end)"
_CAN = "(case {0} " + " ".join(f"when {_q(k)} then {_array(v)}" for k, v in _BACK.items()) + " else []::varchar[] end)"
_SOME = lambda a, cond: f"len(list_filter({a}, lambda y: {cond})) > 0"
_TARGET = ", ".join("{'n': -(" + " + ".join(f"contains(ct, {_q(c)})::int" for c in cues) + f"), 'o': {i}, 'k': '{k}'}}" for i, (k, cues) in enumerate(v5.CUES.items()))
_FIT = "(case okind || ' ' || target " + " ".join(f"when '{k} {t}' then {row.get(t, row['any'])}" for k, row in v5.FIT.items() for t in (*v5.CUES, "any")) + " end)"
_POINT = lambda a, i: f"coalesce(list_sum(list_transform({a}, lambda y: case y.s " + " ".join(f"when '{s}' then {v[i]}" for s, v in v5.POINTS.items()) + " end)), 0)"


def sql(config: dict[str, int] = v5.CONFIG, interpreted: str = "") -> str:
    """Common table expressions up to t5, on opps and orgs. `interpreted` names a table of (id, first, sure, dnorms, subs) that widens the score."""
    text = "tn || case when dn <> '' then ' ' || dn else '' end"
    dn = _norm("substr(description, 1, 500)") if interpreted else "''"
    more = f" join {interpreted} using (id)" if interpreted else ""
    bonus = "0"
    target = "tg"
    if interpreted:
        bonus = f"""case when {_SOME('dnorms', "not list_contains(credited, y.n) and not list_contains(list_transform(fb, lambda g: g.n), y.n) and list_contains(overlap, y.p)")} then 18 else 0 end
          + case when {_SOME('subs', f"len(list_filter(concepts, lambda c: contains({_norm('y')}, c.s))) > 0")} then 12 else 0 end"""
        target = f"case when sure >= 40 then case when {_in('first', list(v5.FIT['nonprofit']))} then first else 'any' end else tg end"
    return (
        rf"""g5 as (select *, {_WORDS} as mw from orgs),
h5 as (select *, list_filter(list_transform(range(1, len(mw) + 1), lambda i: {{'w': mw[i], 'i': i}}), lambda x: not {_in('x.w', v5.CONNECTORS)} and length(x.w) > 2) as hw from g5),
i5a as (select *, list_concat({_kept("list_transform(range(1, len(hw)), lambda k: case when hw[k + 1].i - hw[k].i <= 3 and (length(hw[k].w) > 3 or length(hw[k + 1].w) > 3) then hw[k].w || ' ' || hw[k + 1].w end)")},
    {_kept(f"list_transform(range(1, len(hw) - 1), lambda k: case when hw[k + 2].i - hw[k].i <= 5 and {_LONG('hw[k].w')} + {_LONG('hw[k + 1].w')} + {_LONG('hw[k + 2].w')} >= 2 then hw[k].w || ' ' || hw[k + 1].w || ' ' || hw[k + 2].w end)")}) as graw from h5),
i5 as (select *, {_ordered('graw')} as grams from i5a),
j5 as (select *, list_concat(list_concat({_sourced(_TRIM('keywords'), 'keyword')}, {_sourced(_TRIM('program_areas'), 'program_area')}), list_concat({_sourced('grams', 'mission')}, {_sourced(_TRIM('population_served'), 'population')})) as al from i5),
k5 as (select *, {_kept("list_transform(range(1, len(al) + 1), lambda i: case when not list_contains(list_transform(al[1:i - 1], lambda y: y.p), al[i].p) then al[i] end)")} as phrases from j5),
l5 as (select *, list_concat(list_filter(flatten(list_transform(phrases, lambda x: string_split(x.p, ' '))), lambda w: length(w) > 3 and not {_in('w', v5.GENERIC)} and not {_in('w', v5.CONNECTORS)}),
    list_filter(string_split_regex(lower(mission), '[^A-Za-z0-9_]+'), lambda w: length(w) > 4 and not {_in('w', v5.GENERIC)} and not {_in('w', v5.CONNECTORS)})) as cw from k5),
m5 as (select *, list_transform({_ordered('cw')}, lambda w: {{'w': w, 's': {_stem('w')}}}) as concepts from l5),
o5 as (select id as org_id, phrases, concepts, list_transform(population_served, lambda y: {_norm('y')}) as pops,
    list_transform(list_filter([{_PHRASES}], lambda g: len(list_filter(g.w, lambda w: len(list_filter(concepts, lambda c: c.s = {_stem('w')} or contains(c.w, w) or contains(w, c.w))) > 0)) > 0), lambda g: g.p) as overlap,
    case when org_type = 'small_business' or is_small then 'small_business' when org_type in ('university', 'government', 'tribal', 'healthcare') then org_type when org_type = 'nonprofit' or has_501c3 then 'nonprofit'
      when contains(lower(mission), 'hospital') or contains(lower(mission), 'clinic') then 'healthcare' when contains(lower(mission), 'university') or contains(lower(mission), 'college') then 'university' else 'nonprofit' end as okind,
    {_SOME('geography', "contains(lower(y), 'united states') or contains(lower(y), 'us') or contains(lower(y), 'usa') or contains(lower(y), 'america')")} and not {_SOME('geography', "contains(lower(y), 'global') or contains(lower(y), 'international')")} as us_only from m5),
p5a as (select id, ord, source, lower(title) as lt, {_norm('title')} as tn, {dn} as dn, lower(title || ' ' || array_to_string(eligibility, ' ')) as ct, list_filter(string_split_regex(lower(title), '[\s\-/,()]+'), lambda w: length(w) > 1) as tw from opps where source in ({_ACTIVE})),
p5b as (select *, string_split(tn, ' ') as ta, list_transform(string_split(tn, ' '), lambda w: {_stem('w')}) as ts from p5a),
p5 as (select *, {_kept('[' + ', '.join(_global(p, w) for p, w in v5.MISSION_PHRASES.items()) + ']')} as globals, list_sort([{_TARGET}])[1] as best, contains(source, 'ted_eu') or contains(lt, 'european union') or contains(lt, 'ted eu') or contains(lt, 'ukri') as eu,
    case when len(tw) > 0 then len(list_filter(tw, lambda w: {_in('w', v5.GENERIC)}))::double / len(tw) else 0.0::double end as ratio from p5b{more}),
x5 as (select *, case when best.n < 0 then best.k else 'any' end as tg, list_filter(phrases, lambda y: contains(tn, y.p)) as hits, list_filter(phrases, lambda y: not contains(tn, y.p) and (len(list_filter({_SIBLINGS.format('y.p')}, lambda s: contains(tn, s))) > 0
    or {_NEAR})) as near from p5 cross join o5),
y5 as (select *, {_kept("list_transform(range(1, len(hits) + 1), lambda i: case when len(list_filter(hits[1:i - 1], lambda y: contains(y.p, hits[i].p) and length(y.p) > length(hits[i].p))) = 0 then hits[i] end)")} as exact from x5),
z5 as (select *, list_concat(list_transform(exact, lambda y: y.p), list_transform(near, lambda y: y.p)) as credited, flatten(list_transform(exact, lambda y: string_split(y.p, ' '))) as said from y5),
q5 as (select *, list_filter(globals, lambda g: list_contains(overlap, g.p) and not list_contains(credited, g.n)) as fb, list_filter(concepts, lambda c: not list_contains(said, c.w) and (list_contains(ta, c.w) or list_contains(ts, c.s)))[1:3] as cws from z5),
r5 as (select *, {target} as target, least(60, {_POINT('exact', 0)} + {_POINT('near', 1)} + coalesce(list_sum(list_transform(fb, lambda g: g.v)), 0) + 3 * len(cws) + {bonus}) as raw, {text} as alltext,
    case when len(exact) > 0 then 0.25::double when len(near) > 0 or len(fb) > 0 then 0.60::double when ratio >= 0.50 then 1.40::double else 1.00::double end as factor from q5),
s5 as (select *, {_FIT} as fit, case when ratio >= 0.20::double then floor((ratio - 0.20::double) / 0.50::double * {config['generic_penalty']} + 0.5) else 0 end as gbase,
    coalesce(list_max(list_transform(pops, lambda p: greatest(case when contains(tn, p) then 10 else 0 end, case when dn <> '' and contains(alltext, p) then 8 else 0 end,
      case when len(list_filter({_VAR.format('p')}, lambda v: contains(tn, v))) > 0 then 8 when dn <> '' and len(list_filter({_VAR.format('p')}, lambda v: contains(alltext, v))) > 0 then 6 else 0 end,
      case when len(list_filter({_CAN.format('p')}, lambda v: contains(tn, v))) > 0 then 8 else 0 end, case when len(list_filter(string_split(p, ' '), lambda w: length(w) > 3 and contains(tn, w))) > 0 then 5 else 0 end))), 0) as pop from r5),
u5 as (select *, floor(raw::double / 60 * {config['title_mission_fit']} + 0.5)::bigint as title_mission_fit, floor(fit::double / 25 * {config['org_type_fit']} + 0.5)::bigint as org_type_fit, floor(pop::double / 10 * {config['population_title_fit']} + 0.5)::bigint as population_title_fit,
    case when us_only and eu then floor({config['geography_sanity']} * 0.2::double + 0.5) else floor({config['geography_sanity']} * 0.85::double + 0.5) end::bigint as geography_sanity, least({config['generic_penalty']}, floor(gbase * factor + 0.5))::bigint as generic_penalty from s5),
t5 as (select *, greatest(0, least(100, title_mission_fit + org_type_fit + population_title_fit + geography_sanity - generic_penalty))::bigint as total from u5)"""
    )


_OUTER = lambda a: f"list_filter({a}, lambda p: len(list_filter({a}, lambda o: length(o) > length(p) and contains(o, p))) = 0)[1:2]"
_EXACT, _NEARS = "list_transform(exact, lambda y: y.p)", "list_transform(near, lambda y: y.p)"
_BY_NAME = "(case {0} " + " ".join(f"when {_q(k)} then [" + ", ".join(f"{{'r': {_q(o)}, 'n': {_q(v5.plain_phrase(o))}}}" for o in next(o for n, o in v5.VARIANTS if v5.plain_phrase(n) == k)) + "]" for k in _VARIANTS) + " else []::struct(r varchar, n varchar)[] end)"
_BY_OTHER = "(case {0} " + " ".join(f"when {_q(k)} then [" + ", ".join(f"{{'r': {_q(n)}, 'n': {_q(v5.plain_phrase(n))}}}" for n, o in v5.VARIANTS if k in map(v5.plain_phrase, o)) + "]" for k in _BACK) + " else []::struct(r varchar, n varchar)[] end)"
_FIRST = "list_position(list_transform(pops, lambda p: contains(tn, p)), true)"
_BEFORE = f"case when {_FIRST} > 0 then pops[1:{_FIRST} - 1] else pops end"
_SERVED = f"""array_to_string(list_concat(case when {_FIRST} > 0 then [pops[{_FIRST}]] else []::varchar[] end, flatten(list_transform({_BEFORE}, lambda p: list_concat(
    list_transform(list_filter({_BY_NAME.replace('{0}', 'p')}, lambda v: contains(tn, v.n))[1:1], lambda v: p || ' ≈ "' || v.r || '"'), list_transform(list_filter({_BY_OTHER.replace('{0}', 'p')}, lambda v: contains(tn, v.n)), lambda v: p || ' ≈ "' || v.r || '"')))))[1:2], ', ')"""
_WHY = f"""w5 as (select t5.*, rank, list_transform(list_filter(fb, lambda g: g.x), lambda g: g.p) as full_, list_filter(ta, lambda w: length(w) > 1) as held from t5 join r using (org_id, id) where rank <= 10)
    select org_id, id, rank, concat_ws(' | ',
      case when len(exact) > 0 then 'Org mission phrase in title: ' || array_to_string({_OUTER(_EXACT)}, ', ') when len(near) > 0 then 'Near-match to org phrase in title: ' || array_to_string({_OUTER(_NEARS)}, ', ') when len(full_) > 0 then 'Related domain phrase in title: ' || array_to_string(full_[1:2], ', ') end,
      case when len(cws) > 0 then 'Org focus area words in title: ' || array_to_string(list_transform(cws, lambda c: c.w), ', ') end,
      case when fit >= 22 then 'Strong org-type match: ' || okind || ' = intended applicant' when fit >= 15 then 'Compatible org-type: ' || okind || ' can competitively apply' end,
      case when population_title_fit >= 7 then 'Served population found in title: ' || {_SERVED} end) as reasons,
    concat_ws(' | ', case when len(exact) + len(near) + len(fb) = 0 then 'No org mission concept found in title — check full description before applying' end,
      case when generic_penalty >= 12 then 'Title is highly generic (' || floor(len(list_filter(held, lambda w: length(w) > 2 and not {_in('w', v5.GENERIC)}))::double / len(held) * 100 + 0.5)::bigint || '% specific) — low ranking signal' end,
      case when fit < 8 then case when target <> 'any' then 'Opportunity targets ' || target || 's — org type is ' || okind else 'No org-type cues found in title or eligibility' end end) as risks from w5"""


def oracle_sql() -> dict[str, str]:
    own = f"with {_OPPS}, {_ORGS}, "
    plain = own + sql() + " "
    dims = ", ".join(v5.CONFIG)
    tier = "case when total >= 70 then 'excellent' when total >= 55 then 'strong' when total >= 38 then 'moderate' else 'weak' end as confidence"
    kind = "case when fit >= 22 then 'exact' when fit >= 15 then 'compatible' when fit >= 8 then 'neutral' when fit >= 5 then 'mismatch' else 'strong_mismatch' end as fit_category"
    ranked = "r as (select org_id, id, source, total, row_number() over (partition by org_id order by total desc, ord) as rank from t5)"
    return {
        "v5_scores": plain + f"select org_id, id, {dims}, total, {tier}, target, {kind} from t5",
        "v5_preset_scores": own + sql(TITLE_HEAVY) + f" select org_id, id, {dims}, total, {tier} from t5",
        "v5_interpreted_scores": own + interpretation_queries.profile_sql("iv") + ", " + sql(interpreted="iv") + f" select org_id, id, {dims}, total, {tier}, target from t5",
        "compare_v4_v5": "with " + _V4 + ", " + sql() + f""", {ranked}, r4 as (select org_id, id, total, row_number() over (partition by org_id order by total desc, ord) as rank from t4 where ok4 and total > 0)
            select org_id, id, a.total as total_v4, a.rank as rank_v4, b.total as total_v5, b.rank as rank_v5, a.rank - b.rank as delta from (select * from r4 where rank <= 10) a full join (select * from r where rank <= 10) b using (org_id, id)""",
        "v5_explained_top10": plain + f", {ranked}, " + _WHY,
        "v5_top10": plain + f", {ranked} select * from r where rank <= 10",
        "v5_sweep": plain + "select org_id, count(*) as active, 0::bigint as ineligible, count(*) filter (total = 0) as eligible_zero, count(*) filter (total > 0) as scored, " + ", ".join(f"count(*) filter (total > {n}) as above_{n}" for n in (30, 50, 70, 85)) + " from t5 group by org_id",
        "v5_org_phrases": plain + "select org_id as id, okind as kind, array_to_string(list_transform(phrases, lambda p: p.s || ':' || p.p), ',') as phrases, array_to_string(list_transform(concepts, lambda w: w.w || ':' || w.s), ',') as concepts, array_to_string(overlap, ',') as overlap from o5",
    }
