"""Queries of the interpreter, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings
from ..operators import interpretation as ip
from ..operators import taxonomy as tx
from ..operators.scoring_v5 import GENERIC, MISSION_PHRASES
from ..sources import views
from .oracle import _OPPS, _array
from .oracle_v2 import _any

LEAD = ("FY 2026: ", "NOFO - ", "RFP #12-A: ", "CFDA 93.5 - ", "", "2026-1234: ", "Notice of funding opportunity: ")
TAIL = ("", " - W50S0Y24C9003", " (93AB68)")


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    o, n = views.opportunities(spark, sf), F.col("ord")
    return o.withColumn("title", F.concat(F.get(strings(LEAD), (n % len(LEAD)).cast("int")), "title", F.get(strings(TAIL), (n % len(TAIL)).cast("int"))))


def title_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _titled(spark, sf).select("id", ip.clean_title(F.col("title")).alias("title"))


def _joined(*names: str) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


def interpreted(spark: SparkSession, sf: str) -> DataFrame:
    confidences = [F.col(f"{n}_confidence").cast("long").alias(f"{n}_confidence") for n in ("domain", "activity", "population")]
    return ip.interpret(_titled(spark, sf)).select("id", "clean_title", *_joined("domains", "subdomains", "activities", "populations", "places"), "type", "scope", *confidences)


def intended_org_types(spark: SparkSession, sf: str) -> DataFrame:
    return ip.interpret(_titled(spark, sf)).select("id", F.array_join("applicants", ",").alias("applicants"), F.col("applicant_confidence").cast("long").alias("applicant_confidence"))


def _signals(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ip.interpret(_titled(spark, sf)).select("id", *[F.array_join(F.col(name)[k], ",").alias(k) for k in ("strong", "weak", "exact", "near")])


def title_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf, "title_signals")


def description_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf, "description_signals")


def mission_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of title and description, those of the description alone, and the title's generic words."""
    o = ip.interpret(_titled(spark, sf)).withColumn("desc_phrases", F.transform("desc_phrases", lambda p: p["phrase"]))
    return o.select("id", *_joined("mission_phrases", "all_phrases", "desc_phrases", "generic_terms"))


def queries() -> dict:
    return {q.__name__: q for q in (title_clean, interpreted, intended_org_types, title_signals, description_signals, mission_phrases)}


def _four(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') as {n}" for c, n in zip(columns, ("strong", "weak", "exact", "near"), strict=True))


def _word(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '(^|[^A-Za-z0-9_])({'|'.join(words)})([^A-Za-z0-9_]|$)')" if words else "false"


def _scores(text: str) -> str:
    hits = lambda ps: " + ".join(f"contains({text}, '{p}')::int" for p in ps)
    return "[" + ", ".join(f"case when {hits(ps)} > 0 then ({hits(ps)}) * {w} when {_word(text, ws)} then {int(w * 0.4 + 0.5)} else 0 end" for _, _, w, ps, ws in tx.DOMAINS) + "]"


def _ranked(scores: str, which: int) -> str:
    places: dict[str, list[int]] = {}
    for i, entry in enumerate(tx.DOMAINS, 1):
        places.setdefault(entry[which], []).append(i)
    rows = [f"case when {' + '.join(f'{scores}[{i}]' for i in at)} > 0 then {{'v': -({' + '.join(f'{scores}[{i}]' for i in at)}), 'o': case {' '.join(f'when {scores}[{i}] > 0 then {i}' for i in at)} end, 'n': '{name}'}} end" for name, at in places.items()]
    return f"list_transform(list_sort(list_filter([{', '.join(rows)}], lambda x: x is not null)), lambda x: x.n)"


def _people(text: str) -> str:
    return "list_filter([" + ", ".join(f"case when {_any(text, *ps)} or {_word(text, ws)} then '{tag}' end" for tag, (ps, ws) in tx.POPULATIONS.items()) + "], lambda x: x is not null)"


def _signal_sql(body: str) -> str:
    phrases = _array(list(dict.fromkeys(p for e in tx.DOMAINS for p in e[3])))
    mission = _array(sorted(MISSION_PHRASES, key=lambda p: -MISSION_PHRASES[p]))
    first = lambda a: f"list_transform(list_filter(list_transform(range(1, len({a}) + 1), lambda i: {{'i': i, 'v': {a}[i]}}), lambda x: list_position({a}, x.v) = x.i), lambda x: x.v)[1:8]"
    held = lambda t, p: f"list_filter({p}, lambda x: contains({t}, x))"
    weak = lambda t, n: f"list_filter(string_split_regex({t}, '\\s+'), lambda w: length(w) > {n} and not list_contains({_array(GENERIC)}, w))"
    return f""", e1 as (select *, substr(lb, 1, 2000) as ob, lower(title || ' ' || title || ' ' || {body}) as wb from d),
e2 as (select *, {_scores('lt')} as tsc, {_scores('ob')} as osc, {_scores('wb')} as wsc, {held('lt', phrases)} as tall, {held('ob', phrases)} as oall, {held('lt', mission)}[1:15] as tm, {held('lb', mission)}[1:15] as dm, list_concat({_people('lt')}, list_filter({_people('lb')}, lambda p: not list_contains({_people('lt')}, p))) as people from e1),
e3 as (select *, {_ranked('wsc', 0)} as doms, {_ranked('wsc', 1)} as subs, list_filter({weak('lt', 3)}, lambda w: len(list_filter(tall, lambda p: contains(p, w))) = 0) as tw, {weak('ob', 4)}[1:20] as ow from e2),
e as (select *, tall[1:8] as tph, {first('tw')} as tweak, {_ranked('tsc', 1)}[1:5] as tsub, {_ranked('tsc', 0)}[1:5] as tdom, oall[1:8] as oph, {first('ow')} as oweak, {_ranked('osc', 1)}[1:5] as osub, {_ranked('osc', 0)}[1:5] as odom from e3) """


def _base_sql(titled: bool = True) -> tuple[str, str]:
    """Common table expressions up to d (cleaned titles and lower-cased parts), after opps, and the description as it counts."""
    steps, last = [], "pre0"
    for i, p in enumerate(ip.PREFIXES, 1):
        short = f"trim(regexp_replace(title, '{p}', ''))"
        steps.append(f"pre{i} as (select * exclude (title), case when length({short}) > 10 then {short} else title end as title from {last})")
        last = f"pre{i}"
    body = "case when length(trim(description)) > 20 then trim(description) else '' end"
    title = f"({_array(LEAD)})[1 + ord % {len(LEAD)}] || title || ({_array(TAIL)})[1 + ord % {len(TAIL)}]" if titled else "title"
    base = f"pre0 as (select * exclude (title), trim({title}) as title from opps), " + ", ".join(steps)
    base += rf", c as (select * exclude (title), trim(regexp_replace(trim(regexp_replace(title, '{ip.SUFFIX}', '')), '\s{{2,}}', ' ', 'g')) as title from {last}), d as (select *, lower(title) as lt, lower({body}) as lb, lower(title || ' ' || {body}) as al, lower(array_to_string(eligibility, ' ')) as el from c) "
    return base, body


def _applicant_sql() -> str:
    votes = []
    for i, (k, (e, t, d, sources)) in enumerate(ip.APPLICANTS.items()):
        listed = f"source in ({', '.join(repr(s) for s in sources)})" if sources else "false"
        earlier = [s for j, v in enumerate(ip.APPLICANTS.values()) if j < i for s in v[3]]
        second = f"source in ({', '.join(repr(s) for s in earlier)})" if earlier else "false"
        first_vote = f"case when {listed} and not {second} then 0 when {listed} then 1 else 2 end * 100 + {i}"
        votes.append(f"select id, '{k}' as kind, {first_vote} as o, case when {listed} then case when {second} then 15 else 30 end else 0 end + 20 * {_any('el', *e)}::int + 10 * {_any('lt', *t)}::int + 6 * {_any('lb', *d)}::int as v from d")
    return f", votes as ({' union all '.join(votes)}), kinds as (select *, row_number() over (partition by id order by v desc, o) as n from votes where v > 8), a as (select id, string_agg(kind, ',' order by n) as applicants, min(kind) filter (n = 1) as first, count(*) as n from kinds where n <= 3 group by id) "


def profile_sql(name: str) -> str:
    """Common table expressions, after opps, up to a table of what the title-first scorer takes from the interpreter: id, first, sure, dnorms, subs."""
    base, body = _base_sql(titled=False)
    plain = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[-–—]', ' ', 'g'), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g'))"
    return base + _signal_sql(body) + _applicant_sql() + f""", {name} as (select e.id, coalesce(first, 'any') as first, case when first is null then 20 else least(100, 50 * n) end as sure,
        list_transform(list_filter(dm, lambda x: not list_contains(tm, x))[1:8], lambda x: {{'p': x, 'n': {plain}}}) as dnorms, subs[1:8] as subs from e left join a using (id))"""


def oracle_sql() -> dict[str, str]:
    base, body = _base_sql()
    base = f"with {_OPPS}, {base}"
    signals = _signal_sql(body)
    tags = "array_to_string(list_filter([" + ", ".join(f"case when {_any('al', *a, *b)} then '{t}' end" for t, (a, b) in ip.ACTIVITIES.items()) + "], lambda x: x is not null)[1:6], ',')"
    all_tags = tags.replace("[1:6]", "")
    kind = f"""case when source = 'sbir' then 'research_grant' when source in ('sam_gov', 'ted_eu') then case when {_any('el', 'contractor', 'solicitation')} or contains(lt, 'contract') then 'procurement' else 'contract' end when source = 'world_bank' then 'international_funding'
        when {_any('lt', 'fellowship', 'scholarship')} then 'fellowship' when {_any('lt', 'loan', 'revolving fund')} then 'loan' when {_any('lt', 'challenge', 'prize')} then 'challenge' when contains(lt, 'technical assistance') or contains(el, 'technical assistance') then 'technical_assistance'
        when funding_type = 'contract' then 'contract' else 'grant' end"""
    scope = "case " + " ".join(f"when source = '{s}' then '{v}'" for s, v in ip.SCOPES.items()) + f""" when len(geography) > 0 then case when lower(geography[1]) = 'international' then 'international' when length(geography[1]) < 15 then 'state' else 'national' end
        when {_any('lt', 'national', 'federal')} then 'national' when contains(lt, 'state') then 'state' when {_any('lt', 'local', 'community', 'city', 'county')} then 'local' else 'unknown' end"""
    ranked = _applicant_sql()
    return {
        "title_clean": base + "select id, title from c",
        "interpreted": base
        + signals
        + f"select id, title as clean_title, array_to_string(doms[1:8], ',') as domains, array_to_string(subs[1:8], ',') as subdomains, {tags} as activities, array_to_string(people[1:8], ',') as populations, {kind} as type, {scope} as scope,"
        + f" array_to_string(case when len(geography) > 0 then geography when {scope} = 'unknown' then [] else [{scope}] end, ',') as places, least(100, 50 * len(doms))::bigint as domain_confidence,"
        + f" least(100, 50 * (case when {all_tags} = '' then 0 else len(string_split({all_tags}, ',')) end))::bigint as activity_confidence, least(100, 50 * len(people))::bigint as population_confidence from e",
        "title_signals": base + signals + f"select id, {_four('tph', 'tweak', 'tsub', 'tdom')} from e",
        "description_signals": base + signals + f"select id, {_four('oph', 'oweak', 'osub', 'odom')} from e",
        "mission_phrases": base + signals + r"""select id, array_to_string(list_concat(tm, list_transform(subs, lambda x: replace(x, '_', ' ')))[1:12], ',') as mission_phrases, array_to_string(list_concat(tm, list_filter(dm, lambda x: not list_contains(tm, x)))[1:12], ',') as all_phrases,
          array_to_string(list_filter(dm, lambda x: not list_contains(tm, x))[1:8], ',') as desc_phrases, """ + f"array_to_string(list_filter(string_split_regex(lt, '[\\s\\-/,()]+'), lambda w: list_contains({_array(GENERIC)}, w)), ',') as generic_terms from e",
        "intended_org_types": base + ranked + "select d.id, coalesce(applicants, 'any') as applicants, case when applicants is null then 20 else least(100, 50 * n) end::bigint as applicant_confidence from d left join a using (id)",
    }
