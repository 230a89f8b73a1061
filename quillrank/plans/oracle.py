"""DuckDB SQL for the queries, written apart from the Spark operators. Views and scores are common table expressions."""

from __future__ import annotations

from ..functions.text import STOPWORDS, SYNONYMS, plain_topic_tokens
from ..operators.scoring_v1 import VARIANTS
from ..sources.registry import SOURCES
from ..sources.views import ELIGIBILITY, FRAMES, FUNDING, NOTES, ORG_TYPES, PHRASES


def _array(values: tuple | list) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]::varchar[]"


def _pick(values: tuple, n: str) -> str:
    return f"({_array(values)})[1 + (({n}) % {len(values)})]"


_ELIG = "(case doc_id % 8 " + " ".join(f"when {i} then {_array(e)}" for i, e in enumerate(ELIGIBILITY)) + " end)"
_ACTIVE = ", ".join(f"'{s[0]}'" for s in SOURCES if s[5] == "active")
_OPPS = f"""
opps as (
  select 'doc_' || doc_id as id, doc_id as ord, {_pick(tuple(s[0] for s in SOURCES), "cast(substr(source, 4) as int)")} as source, source as source_raw,
    {_pick(PHRASES, "doc_id")} || ' ' || {_pick(FRAMES, "doc_id")} as title,
    {_pick(PHRASES, "doc_id * 7 + 3")} || ' ' || {_pick(NOTES, "doc_id")} || coalesce(' ' || text, '') as description,
    {_pick(FUNDING, "doc_id")} as funding_type,
    case when doc_id % 13 = 12 then null when doc_id % 11 = 10 then 'rolling' else strftime(date '2026-03-01' + cast(doc_id * 3 % 180 as int), '%Y-%m-%d') end as close_date,
    case when doc_id % 6 <> 0 then n_chars * 10 end as min_award, case when doc_id % 5 <> 0 then n_chars * 100 end as max_award,
    {_ELIG} as eligibility, [{_pick(PHRASES, "doc_id * 3 + 1")}] as categories, [{_pick(PHRASES, "doc_id")}, {_pick(PHRASES, "doc_id * 5 + 2")}] as keywords,
    case lang when 'en' then ['United States'] when 'fr' then ['European Union'] when 'de' then ['International'] else []::varchar[] end as geography
  from documents)"""
_ORGS = f"""
orgs as (
  select 'org_' || n_nationkey as id, n_name as name, {_pick(ORG_TYPES, "n_nationkey")} as org_type,
    'We advance ' || {_pick(PHRASES, "n_nationkey")} || ' and ' || {_pick(PHRASES, "n_nationkey * 2 + 5")} || ' for all our neighbours.' as mission,
    [{_pick(PHRASES, "n_nationkey")}, {_pick(PHRASES, "n_nationkey + 9")}] as program_areas, [{_pick(("youth", "veterans", "families", "seniors"), "n_nationkey")}] as population_served,
    case r_name when 'AMERICA' then ['Ohio', 'United States'] when 'EUROPE' then ['European Union'] when 'ASIA' then ['global'] else ['Kenya'] end as geography,
    (n_nationkey + 1) * 75000.0::double as budget, n_nationkey % 8 as years,
    {_pick(ORG_TYPES, "n_nationkey")} = 'nonprofit' and n_nationkey % 3 <> 0 as has_501c3, {_pick(ORG_TYPES, "n_nationkey")} = 'small_business' as is_small,
    [{_pick(PHRASES, "n_nationkey * 4 + 1")}, {_pick(PHRASES, "n_nationkey")}] as keywords
  from nation join region on n_regionkey = r_regionkey)"""


def _tokens(text: str, stop: bool = False) -> str:
    more = f" and not list_contains({_array(STOPWORDS)}, x)" if stop else ""
    return rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2{more})"


def _group(tokens: str, topic: str) -> str:
    return "(" + " or ".join(f"list_has_all({tokens}, {_array(plain_topic_tokens(p))})" for p in [topic, *SYNONYMS[topic]]) + ")"


def _expanded(tokens: str) -> str:
    """Distinct tokens after expansion."""
    parts = "".join(f" || case when {_group(tokens, k)} then {_array([t for p in [k, *v] for t in plain_topic_tokens(p)])} else []::varchar[] end" for k, v in SYNONYMS.items())
    return f"list_distinct({tokens}{parts})"


_ORG_TEXT = "mission || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(program_areas, ' ') || ' ' || array_to_string(population_served, ' ')"
_OPP_TEXT = "title || ' ' || description || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(categories, ' ')"
_PAIRS = (
    _OPPS + "," + _ORGS + f""",
o as (select *, {_tokens(_ORG_TEXT)} as toks, list_distinct({_tokens(_ORG_TEXT, True)}) as topics from orgs),
p as (select *, list_transform(eligibility, lambda e: lower(e)) as elig, list_distinct({_tokens(_OPP_TEXT)}) as toks, list_distinct({_tokens(_OPP_TEXT, True)}) as topics,
  regexp_matches(lower(description || ' ' || title), 'experience|track record|prior federal|established') as wants from opps),
x as (
  select o.id as org_id, p.id, p.ord, p.source, p.title, p.description, p.funding_type, p.eligibility, p.elig, p.keywords, p.geography, p.min_award, p.max_award, o.org_type, o.has_501c3, o.is_small, o.budget, o.years, o.keywords as org_keywords, o.geography as org_geography,
    o.toks as o_toks, p.toks as p_toks, o.topics as o_topics, p.topics as p_topics, p.wants,
    len(elig) = 0 or not (
      (list_has_any(elig, ['nonprofit', '501c3', 'community_based_org', 'community_org']) and not list_has_any(elig, ['for_profit', 'small_business', 'all']) and org_type <> 'nonprofit')
      or (list_has_all(['small_business', 'for_profit', '8a_certified'], elig) and not is_small and org_type <> 'small_business')
      or (list_contains(elig, '501c3') and not has_501c3)) as ok,
    case when len(p.geography) = 0 or list_has_any(list_transform(p.geography, lambda g: lower(g)), ['global', 'international']) then 'open'
      when len(list_filter(o.geography, lambda a: len(list_filter(p.geography, lambda b: contains(lower(a), lower(b)) or contains(lower(b), lower(a)))) > 0)) > 0 then 'match' else 'none' end as geo,
    case when coalesce(max_award, 0) = 0 then 'unknown' when max_award >= budget * 0.1 and coalesce(min_award, 0) <= budget * 2.0 then 'ideal'
      when max_award >= budget * 0.1 * 0.5 and coalesce(min_award, 0) <= budget * 2.0 * 1.5 then 'near' when max_award < budget * 0.1 * 0.1 then 'small'
      when coalesce(min_award, 0) > budget * 2.0 * 3 then 'large' else 'partial' end as fund
  from p cross join o)"""
)
_BONUS = "(case when list_contains(elig, org_type) then 5 else 0 end + case when has_501c3 and list_contains(elig, '501c3') then 3 else 0 end + case when is_small and list_contains(elig, 'small_business') then 2 else 0 end)"
_FIVE = "mission_topic_fit + eligibility_fit + geography_fit + funding_size_fit + maturity_fit"
_V1 = (
    _PAIRS + f""",
y as (select *, len(list_filter(o_toks, lambda t: list_contains(p_toks, t))) as hits, len(list_distinct(o_toks)) as uniq from x where source in ({_ACTIVE})),
z as (select *,
    case when not ok then 0 else cast(floor(least(60.0::double, hits::double / least(uniq, 20) * 60 + case when hits > 0 then 8 else 0 end) + 0.5) as bigint) end as mission_topic_fit,
    case when not ok then 0 when len(elig) = 0 then 10 else least(20, 10 + {_BONUS}) end::bigint as eligibility_fit,
    case when not ok then 0 else case geo when 'open' then 7 when 'match' then 10 else 0 end end::bigint as geography_fit,
    case when not ok then 0 else case fund when 'unknown' then 3 when 'ideal' then 5 when 'near' then 3 when 'partial' then 2 else 1 end end::bigint as funding_size_fit,
    case when not ok then 0 when years >= 5 then 5 when years >= 3 then case when wants then 3 else 4 end when years >= 1 then case when wants then 2 else 3 end else 1 end::bigint as maturity_fit
  from y),
s as (select *, ok as passes_eligibility, {_FIVE} as total from z),
ranked as (select *, row_number() over (partition by org_id order by total desc, ord) as rank from s where ok and total > 0)"""
)


def _audit(variant: str, suffix: str = "") -> str:
    w, synonyms = VARIANTS[variant]
    own = _expanded("o_topics") if synonyms else "o_topics"
    point = lambda raw, most, weight: f"case when ok then cast(floor(({raw})::double / {most} * {weight} + 0.5) as bigint) else 0 end"
    own_cte = f"own{suffix} as (select id as own_id, {own.replace('o_topics', 'topics')} as own from o)"
    return f"""
{own_cte},
ym{suffix} as (select x.*, list_filter(own, lambda t: list_contains(p_topics, t)) as matched, len(own) as uniq from x join own{suffix} on own_id = org_id),
za{suffix} as (select *,
    {point("floor(least(35.0::double, len(matched)::double / least(uniq, 20) * 35 + case when len(matched) > 0 then 5 else 0 end) + 0.5)", 35, w[0])} as mission_topic_fit,
    {point(f"case when len(elig) = 0 then 15 else least(25, 15 + {_BONUS}) end", 25, w[1])} as eligibility_fit,
    {point("case geo when 'open' then 10 when 'match' then 15 else 0 end", 15, w[2])} as geography_fit,
    {point("case fund when 'unknown' then 8 when 'ideal' then 15 when 'near' then 10 when 'partial' then 6 else 3 end", 15, w[3])} as funding_size_fit,
    {point("case when years >= 5 then 10 when years >= 3 then case when wants then 6 else 8 end when years >= 1 then case when wants then 3 else 6 end else 2 end", 10, w[4])} as maturity_fit
  from ym{suffix}),
sa{suffix} as (select *, ok as passes_eligibility, {_FIVE} as total from za{suffix}),
ra{suffix} as (select *, row_number() over (partition by org_id order by total desc, ord) as rank from sa{suffix} where ok and total > 0)"""


_DIMS = "mission_topic_fit, eligibility_fit, geography_fit, funding_size_fit, maturity_fit"
_LABELS = """
labs as (select 'doc_' || doc_id as opp_id, 'org_' || (doc_id % 25) as org_id,
    case when quality = 1 then case when doc_id % 2 = 0 then 'strong_fit' else 'possible_fit' end else case when doc_id % 2 = 0 then 'weak_fit' else 'not_a_fit' end end as eval_label,
    case when toxic = 1 then 'bad' when quality = 1 then 'good' when doc_id % 3 = 0 then 'unsure' else 'weak' end as feedback from labels)"""
_MEDIAN = "select org_id, list_sort(list(total))[1 + len(list(total)) // 2] as median_score from sa where ok group by org_id"
_RECORDS = (
    _OPPS + ", cls(source, classification) as (values " + ", ".join(f"('{s[0]}', '{s[2]}')" for s in SOURCES) + """),
rec as (select opps.*, classification, source || '::' || ord as dedupe_key, 1767225600 + ord * 37 % 5000 as stamp from opps join cls using (source)),
hashed as (select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(dedupe_key, ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 31 + c) % 4294967296) as h from rec),
signed as (select *, abs(case when h >= 2147483648 then h - 4294967296 else h end) as v from hashed),
records as (select *, 'idx_' || ltrim(list_reduce(list_prepend('', list_transform(range(7), lambda i: ('0123456789abcdefghijklmnopqrstuvwxyz')[1 + (v // (36 ** (6 - i))::bigint) % 36])), lambda a, c: a || c), '0')
    || '_' || regexp_replace(substr(dedupe_key, 1, 32), '[^A-Za-z0-9]', '_', 'g') as rid from signed)"""
)
_EVENTS = """
ev as (select event_id, ts, user_id as source_user_id, case event_type when 'view' then 'opportunity.viewed' when 'signup' then 'user.created' when 'purchase' then 'opportunity.saved' when 'click' then 'opportunity.applied' else event_type end as event_type,
    json_extract_string(props, '$.k') as opp_id, value from events)"""
_REASONS = """
case when ok then concat_ws(' | ',
    case when eligibility_fit >= 15 then case when org_type = 'nonprofit' then 'Eligible nonprofit applicant type confirmed' when is_small then 'Eligible small business applicant type confirmed' end when eligibility_fit >= 10 then 'Meets basic eligibility requirements' end,
    case when has_501c3 then '501(c)(3) status satisfies tax-exempt requirement' end, case when is_small then 'Small business designation aligns with set-aside opportunities' end,
    case when mission_topic_fit >= 40 then case when len(kw) > 0 then 'Strong topic overlap: ' || array_to_string(kw[1:3], ', ') else 'Strong mission and topic alignment with funding priorities' end
      when mission_topic_fit >= 25 then 'Moderate topic alignment with opportunity focus areas' end,
    case when geography_fit = 10 then 'Geographic fit: ' || org_geography[1] || ' aligns with opportunity coverage' when geography_fit >= 6 then 'Opportunity open to international or wide geographic applicants' end,
    case when funding_size_fit >= 4 then 'Award size appears realistic for this organization''s budget scale' end, case when maturity_fit >= 4 then 'Organization''s operational history demonstrates funding capacity' end) else '' end"""
_RISKS = """
list_filter([case when mission_topic_fit < 20 then 'Limited keyword overlap — mission alignment may be weak' end, case when years < 2 then 'Organization is early-stage; funders may require established track record' end,
    case when funding_type in ('contract', 'procurement') then 'Contract/procurement opportunity may require past performance documentation' end, case when max_award > 0 and max_award > budget * 3 then 'Award ceiling significantly exceeds annual budget — capacity risk' end,
    case when min_award > 0 and min_award < budget * 0.05 then 'Minimum award may be too small relative to organizational overhead' end,
    case when contains(lower(description || ' ' || title), 'competitive') then 'Opportunity may be highly competitive — strong applications required' end,
    case when list_has_any(list_transform(geography, lambda g: lower(g)), ['international', 'global']) then 'International scope may present compliance or reporting complexity' end,
    case when source = 'ted_eu' or list_contains(geography, 'European Union') then 'EU procurement may require business registration or local partner' end,
    case when not has_501c3 and list_contains(eligibility, '501c3') then '501(c)(3) required — organization may not currently qualify' end], lambda r: r is not null)"""


_UPSERTED = "select dedupe_key, case when ord % 3 = 0 then title || ' v2' else title end as title, case when ord % 2 <> 0 then 'type1' else funding_type end as funding_type from rec where ord % 2 = 0 or ord % 3 = 0"


def oracle_sql() -> dict[str, str]:
    v1, aud = "with " + _V1 + " ", "with " + _PAIRS + "," + _audit("v1_current")
    three = ("v1_current", "v1_mission_heavy", "v1_synonyms")
    out = {
        "v1_scores": v1 + f"select org_id, id, passes_eligibility, {_DIMS}, total from s",
        "v1_top10": v1 + "select org_id, id, source, total, rank from ranked where rank <= 10",
        "v1_explained_top10": v1 + f", k as (select *, list_filter(org_keywords, lambda w: contains(lower(title || ' ' || description || ' ' || array_to_string(keywords, ' ')), lower(w))) as kw from ranked where rank <= 10) select org_id, id, rank, {_REASONS} as reasons, array_to_string({_RISKS}, ' | ') as risks from k",
        "v1_capped_top": v1 + ", c as (select *, row_number() over (partition by org_id, source order by total desc, ord) as n from ranked), d as (select org_id, id, source, total, row_number() over (partition by org_id order by total desc, ord) as rank from c where n <= 3) select * from d where rank <= 10",
        "audit_scores": aud + f" select org_id, id, passes_eligibility, {_DIMS}, total, len(matched)::bigint as n_matched from sa",
        "audit_weighted_variants": "with " + _PAIRS + "," + ",".join(_audit(v, f"_{v}") for v in VARIANTS) + " " + " union all ".join(f"select '{v}' as variant, org_id, id, total, rank from ra_{v} where rank <= 20" for v in VARIANTS),
        "compare_v1_audit": v1 + "," + _audit("v1_current") + """, a as (select org_id, id as opp_id, total as score_1, rank as rank_1 from ranked where rank <= 20), b as (select org_id, id as opp_id, total as score_2, rank as rank_2 from ra where rank <= 20)
            select org_id, opp_id, score_1, rank_1, score_2, rank_2, rank_1 - rank_2 as rank_delta, score_2 - score_1 as score_delta,
            case when rank_1 is null then 'new' when rank_2 is null then 'dropped' when rank_1 - rank_2 >= 3 then 'rose' when rank_1 - rank_2 <= -3 then 'fell' else 'stable' end as flag from a full join b using (org_id, opp_id)""",
        "compare_variants": "with " + _PAIRS + "," + ",".join(_audit(v, f"_{v}") for v in three) + ", u as (" + " union all ".join(f"select '{v}' as v, org_id, id as opp_id, total as score, rank from ra_{v} where rank <= 20" for v in three) + "), w as (select org_id, opp_id, "
        + ", ".join(f"coalesce(max(score) filter (v = '{v}'), 0) as score_{v}, coalesce(max(rank) filter (v = '{v}'), 999) as rank_{v}" for v in three)
        + ", max(rank) - min(rank) as rank_spread from u group by org_id, opp_id) select *, case when rank_v1_current = 999 and rank_v1_mission_heavy < 999 then 'new' when rank_v1_mission_heavy < rank_v1_current - 2 then 'rises' when rank_v1_mission_heavy > rank_v1_current + 2 then 'falls' else 'stable' end as flag from w",
        "sweep_funnel": v1 + "select org_id, count(*) as active, count(*) filter (not ok) as ineligible, count(*) filter (ok and total = 0) as eligible_zero, count(*) filter (ok and total > 0) as scored, " + ", ".join(f"count(*) filter (ok and total > {n}) as above_{n}" for n in (30, 50, 70, 85)) + " from s group by org_id",
        "sweep_histogram": v1 + "select org_id, bin::int as bin, count(*) filter (ok and total > 0 and least(9, (total - 1) // 10) = bin) as n from s cross join range(10) b(bin) group by org_id, bin",
        "sweep_by_source": v1 + "select org_id, source, count(*) as total, count(*) filter (ok) as eligible, count(*) filter (ok and total > 0) as scored, coalesce(floor(avg(total) filter (ok and total > 0) * 100 + 0.5), 0)::bigint as avg_x100, coalesce(max(total) filter (ok and total > 0), 0) as top from s group by org_id, source",
        "sweep_types": v1 + "select org_id, funding_type, count(*) as n from s where ok and total > 0 group by org_id, funding_type",
        "dimension_avgs": v1 + "select org_id, " + ", ".join(f"floor(sum({d})::double / count(*) * 10 + 0.5)::bigint as {d}" for d in _DIMS.split(", ")) + " from s where ok and total > 0 group by org_id",
        "risk_counts": v1 + f"select org_id, trim(regexp_replace(risk, '\\s*[—(].*$', '', 's')) as risk, count(*) as n from (select org_id, unnest({_RISKS}) as risk from s where ok and total > 0) group by all",
        "tier_counts": v1 + "select org_id, count(*) filter (total >= 70) as excellent, count(*) filter (total >= 55 and total < 70) as strong, count(*) filter (total >= 38 and total < 55) as moderate from s where ok group by org_id",
        "upper_median": aud + " " + _MEDIAN,
    }
    metrics = aud + "," + _LABELS + f""", med as ({_MEDIAN}),
        b as (select org_id, count(*) as total_scored, count(*) filter (ok) as eligible, count(*) filter (not ok) as ineligible, coalesce(floor(avg(total) filter (ok) + 0.5), 0)::bigint as avg_score,
            floor(count(*) filter (not ok)::double / count(*) * 100 + 0.5)::bigint as filtered_pct, {", ".join(f"count(*) filter (ok and total > {lo} and total <= {hi}) as upto_{hi}" for lo, hi in ((-1, 20), (20, 40), (40, 60), (60, 80), (80, 10000)))} from sa group by org_id),
        t as (select ra.org_id, count(*) as n10, count(*) filter (rank <= 5) as n5, count(*) filter (eval_label in ('strong_fit', 'possible_fit')) as r10, count(*) filter (eval_label in ('strong_fit', 'possible_fit') and rank <= 5) as r5,
            count(*) filter (feedback = 'bad') as bad, floor(avg(case feedback when 'good' then 3 when 'weak' then 2 when 'bad' then 1 when 'unsure' then 0 end) * 100 + 0.5)::bigint as avg_rating_x100
            from ra left join labs on labs.org_id = ra.org_id and opp_id = id where rank <= 10 group by ra.org_id),
        q as (select org_id, count(*) as labeled, count(*) filter (eval_label in ('strong_fit', 'possible_fit')) as rel from labs group by org_id),
        m as (select org_id, total_scored, eligible, ineligible, avg_score, filtered_pct, upto_20, upto_40, upto_60, upto_80, upto_10000, coalesce(median_score, 0) as median_score, coalesce(bad, 0) as bad_in_top_10, avg_rating_x100,
            case when labeled > 0 and n5 > 0 then floor(r5::double / n5 * 100 + 0.5)::bigint end as precision_at_5, case when labeled > 0 and n10 > 0 then floor(r10::double / n10 * 100 + 0.5)::bigint end as precision_at_10,
            case when rel > 0 then floor(coalesce(r10, 0)::double / rel * 100 + 0.5)::bigint end as recall
            from b left join med using (org_id) left join t using (org_id) left join q using (org_id))"""
    generic = "['community', 'support', 'innovation', 'development', 'program', 'services', 'public']"
    out["metrics_precision_recall"] = metrics + " select * from m"
    out["recommendations"] = metrics + f""", g as (select org_id, avg(mission_topic_fit) filter (rank <= 10) as mission, count(*) filter (len(matched) = 0) as zero, count(*) filter (len(matched) < 4 and list_has_any(matched, {generic})) as gen,
            count(*) filter (geography_fit = 0) as geo0, count(*) filter (coalesce(max_award, 0) = 0) as noamt, count(*) filter (len(matched) < 3) as thin from ra where rank <= 20 group by org_id), h as (select * from m left join g using (org_id))
        select org_id, 'high' as priority, 'Scoring Weights' as category from h where mission < 30 union all select org_id, 'high', 'Keyword Matching' from h where zero > 3 union all select org_id, 'medium', 'Keyword Quality' from h where gen > 3
        union all select org_id, 'medium', 'Geography' from h where geo0 > 8 union all select org_id, 'medium', 'Eligibility' from h where filtered_pct < 10 and total_scored > 50 union all select org_id, 'medium', 'Calibration' from h where avg_score < 30 and mission is not null
        union all select org_id, 'low', 'Funding Data' from h where noamt > 10 union all select org_id, 'high', 'False Positives' from h where bad_in_top_10 > 0 union all select org_id, 'low', 'Synonym Expansion' from h where thin > 5"""
    out["failure_classes"] = aud + "," + _LABELS + f""", r as (select ra.*, feedback from ra left join labs on labs.org_id = ra.org_id and opp_id = id where rank <= 20),
        fn as (select sa.org_id, sa.id, row_number() over (partition by sa.org_id order by sa.ord) as n from sa join labs on labs.org_id = sa.org_id and opp_id = sa.id and feedback = 'good' where total < 30 and not exists (select 1 from r where r.org_id = sa.org_id and r.id = sa.id)),
        fo as (select org_id, id, row_number() over (partition by org_id order by ord) as n from sa where coalesce(max_award, 0) > 0 and funding_size_fit <= 3), el as (select org_id, id, row_number() over (partition by org_id order by ord) as n from sa where not ok)
        select org_id, 'false_positive' as class, id as opp_id from r where rank <= 10 and (coalesce(feedback, '') = 'bad' or (len(matched) = 0 and total > 20))
        union all select org_id, 'generic_keyword_hit', id from r where len(matched) > 0 and list_has_all({generic}, matched) and mission_topic_fit > 10 union all select org_id, 'geo_mismatch', id from r where geography_fit = 0
        union all select org_id, 'false_negative', id from fn where n <= 5 union all select org_id, 'funding_outlier', id from fo where n <= 5 union all select org_id, 'eligibility_edge_case', id from el where n <= 5"""
    opps, rec, ev = "with " + _OPPS + " ", "with " + _RECORDS + " ", "with " + _EVENTS + " "
    text = "title || ' ' || description"
    out |= {
        "active_filter": opps + f"select id, source from opps where source in ({_ACTIVE})",
        "source_alias": opps + "select id, case ord % 3 when 0 then 'sbir' when 1 then 'world_bank' else source_raw end as source from opps",
        "expired_filter": opps + "select id, close_date from opps where try_cast(close_date as date) is null or try_cast(close_date as date) >= date '2026-04-01'",
        "pool_search": opps + "select id from opps where funding_type = 'grant' and contains(lower(title || ' ' || description || ' ' || array_to_string(keywords, ' ')), 'energy')",
        "deterministic_id": rec + "select rid as id, dedupe_key from records",
        "ilike_search": rec + "select dedupe_key, title from records where classification = 'active_opportunity' and title ilike '%health%grant%'",
        "records_page": rec + "select rid as id, source, title, dedupe_key from records order by stamp desc, rid limit 50 offset 50",
        "count_by_source": rec + "select source, count(*) as n from rec group by source",
        "stats_by_classification": rec + "select count(*) as total, count(*) filter (classification = 'active_opportunity') as active, count(*) filter (classification = 'historical_intelligence') as historical from rec",
        "delete_by_source": rec + "select dedupe_key, source from rec where source <> 'sbir'",
        "store_batches": rec + _UPSERTED,
        "upsert_merge": rec + _UPSERTED,
        "upsert_counts": rec + "select count(*) filter (ord % 2 <> 0) as inserted, 2 * count(*) filter (ord % 2 = 0) + count(*) filter (ord % 2 <> 0) as updated, 0::bigint as errors from rec where ord % 3 = 0",
        "dedupe_first_wins": opps + "select id, source, title from opps qualify row_number() over (partition by source, substr(title, 1, 80) order by ord) = 1",
        "tokenize_terms": opps + f"select id, array_to_string({_tokens(text)}, ' ') as tokens, array_to_string({_tokens(text, True)}, ' ') as topics, trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) as norm from opps",
        "top_terms": f"with t as (select doc_id, {_tokens('text', True)} as t from documents), e as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as pos from t), c as (select doc_id, term, count(*) as n, min(pos) as pos from e group by doc_id, term), r as (select doc_id, term, n, row_number() over (partition by doc_id order by n desc, pos) as rank from c) select * from r where rank <= 15",
        "synonym_expand": opps + f", t as (select id, {_tokens(text, True)} as t from opps) select id, len({_expanded('t')})::bigint as n_expanded, array_to_string(list_filter([{', '.join(f'case when {_group(chr(116), k)} then {chr(39)}{k}{chr(39)} end' for k in SYNONYMS)}], lambda g: g is not null), ',') as groups from t",
        "parse_amount": "select doc_id, case doc_id % 5 when 0 then nullif(doc_id * 1234, 0) when 1 then cast(floor(doc_id + 0.6 + 0.5) as bigint) when 4 then doc_id end as ingest, case doc_id % 5 when 0 then nullif(doc_id * 1234, 0) when 1 then doc_id + 0.6::double when 2 then null else nullif(doc_id, 0) end::double as live from documents",
        "event_counts": ev + "select event_type, count(*) as n, count(distinct source_user_id) as users from ev where event_type <> 'error' group by event_type",
        "status_toggle": ev + """, t as (select *, case event_type when 'opportunity.saved' then 'saved' else 'applied' end as status, row_number() over w as i, row_number() over (partition by source_user_id, opp_id, event_type order by ts, event_id) as j
            from ev where event_type in ('opportunity.saved', 'opportunity.applied') and opp_id is not null window w as (partition by source_user_id, opp_id order by ts, event_id)),
            r as (select source_user_id, opp_id, status, count(*) as n, max(i) as last from t group by source_user_id, opp_id, status, i - j)
            select source_user_id, opp_id, status from r qualify row_number() over (partition by source_user_id, opp_id order by last desc) = 1 and n % 2 = 1""",
        "latest_label": ev + "select opp_id, case when value > 20 then 'good' else 'weak' end as label from ev qualify row_number() over (partition by opp_id order by ts desc, event_id desc) = 1",
    }
    return out
