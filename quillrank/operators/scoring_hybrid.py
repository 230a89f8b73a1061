"""The hybrid scorer: keyword signals (V1) and profile signals (V2) blended dimension by dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import SECTORS, bits
from ..functions.text import js_round, strings
from ..sources.staging import staged
from . import scoring_v1 as v1
from . import scoring_v2 as v2
from .bounds import points_of_cases
from .pairs import pair_up, prefixed, said_by, spread

DIMENSIONS = ("mission_domain", "eligibility", "org_type_fit", "activity_fit", "geography_fit", "capacity_fit", "funding_fit", "population_fit")
#: The first bit of the organizations' own types among applicant_bits.
_KINDS = 6 + len(v2.ALIASES)


def _wants_experience() -> Column:
    """V1's rule. It joins description and title the other way round, so phrases are looked for there, where both words were read."""
    body = F.lower(F.concat_ws(" ", "description", "title"))
    phrase = lambda a, b: v2.said(a) & v2.said(b) & body.contains(f"{a} {b}")
    return v2.said("experience", "established") | phrase("track", "record") | phrase("prior", "federal")


def sides(opps: DataFrame, orgs: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of both scorers; of an opportunity's tokens only those that some organization says, which are read in the same pass as the tags."""
    own = v2.org_profiles(v1.with_org_columns(orgs).drop("geo"), sectors)
    known = said_by(own, "tokens")
    read = v2.read_texts(spread(opps), sectors, known or ())
    tokens = F.array_distinct(v1.text_tokens()) if known is None else v2.tokens_read(known, sectors)
    some = F.lit(None).cast("array<bigint>") if known is None else v2.token_bits_read(known, sectors)
    return v2.profiled(read.withColumns(v1.applicant_rules() | {"tokens": tokens, "token_bits": some, "wants_experience": _wants_experience()}), sectors), own


def pairs(opps: DataFrame, orgs: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    return pair_up(*sides(opps, orgs, sectors))


def _mission(first: Column, domain: Column) -> Column:
    return js_round(0.6 * (first / 60) * 25 + 0.4 * (domain / 20) * 25)


def _funding(first: Column, second: Column) -> Column:
    return js_round(0.5 * (first / 5) * 8 + 0.5 * (second / 5) * 8)


def _penalty() -> Column:
    return F.aggregate(v2.penalties(), F.lit(0), lambda s, p: s + p["value"])


def _with_token_bits(own: DataFrame) -> DataFrame:
    """Adds an organization's tokens as the bits of `token_bits`: those said once or three times, and those said twice or three times; and how often some are said beyond that; and how many distinct ones there are."""
    known = said_by(own, "tokens") or []
    keys, zero = F.map_keys("weights"), F.lit(0).cast("long")
    times = lambda t: F.least(F.col("weights")[t], F.lit(3))
    plane = lambda part, p: bits(F.filter(keys, lambda t: times(t).bitwiseAND(p) != 0), part)
    parts = [known[i : i + 63] for i in range(0, len(known), 63)]
    numbers = F.array(*[F.struct(plane(part, 1).alias("odd"), plane(part, 2).alias("twice")) for part in parts]) if parts else F.expr("cast(array() as array<struct<odd:bigint,twice:bigint>>)")
    often = F.aggregate(keys, F.lit(0), lambda m, t: m + F.col("weights")[t] - times(t))
    return own.withColumns({"token_bits": numbers, "often": often, "unique": F.size("weights")})


def _hits() -> Column:
    """V1's hits by bits, or more where a token is said more than three times; null, which counts as at its best, where the tokens aren't known."""
    shared = F.zip_with("token_bits", "org_token_bits", lambda a, b: F.bit_count(a.bitwiseAND(b["odd"])) + F.bit_count(a.bitwiseAND(b["twice"])) * 2)
    return F.aggregate(shared, F.col("org_often"), lambda m, n: m + n)


def _bit(n: int, when: Column) -> Column:
    return F.when(when, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long"))


def _union(*some: Column) -> Column:
    return reduce(Column.bitwiseOR, some)


def _with_applicant_bits(mine: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds applicant types as bits of one number: by which rule they refuse, what earns points, the classes that satisfy one, the organizations' own types. Of an organization: which refusals of each gate hit it, and its own bits."""
    e, aliases = F.col("elig"), list(v2.ALIASES)
    kinds = said_by(own.select(F.array("org_type").alias("kinds")), "kinds")
    kinds = kinds if kinds is not None and len(kinds) <= 63 - _KINDS else None
    facts = [F.col("nonprofit_only"), F.col("business_only"), F.array_contains(e, "501c3"), F.array_contains(e, "small_business"), F.col("takes_small"), F.array_contains(e, "all")]
    facts += [F.arrays_overlap(e, strings(v2.ALIASES[c])) for c in aliases] + [F.array_contains(e, k) for k in kinds or ()]
    mine = mine.withColumn("applicant_bits", _union(*[_bit(n, f) for n, f in enumerate(facts)]) if kinds is not None else F.lit(None).cast("long"))
    cases = [{"eligibility": list(x), "elig": list(x)} for x in (("nonprofit",), ("small_business",), ("501c3", "all"))]  # each is refused by one rule alone
    told = prefixed(own)
    for name, passes in (("refused1", v1.passes_eligibility()), ("refused2", v2.passes())):
        passes = F.coalesce(passes, F.lit(True)).cast("int")
        rows = points_of_cases(told, name, [c | {"nonprofit_only": n == 0, "business_only": n == 1} for n, c in enumerate(cases)], "eligibility:array<string>,elig:array<string>,nonprofit_only:boolean,business_only:boolean", passes)
        own = own.join(rows.withColumnRenamed("org_id", "_of"), F.col("id") == F.col("_of")).drop("_of").withColumn(name, _union(*[_bit(n, F.get(name, F.lit(n)) == 0) for n in range(3)]))
    return mine, own.withColumns({
        "own_501c3": _bit(2, F.col("has_501c3")), "own_small": _bit(3, F.col("is_small_business")), "own_business": _bit(4, F.col("is_small_business")),
        "own_class": _union(F.lit(0).cast("long"), *[_bit(6 + n, F.col("class") == c) for n, c in enumerate(aliases)]), "own_type": _union(F.lit(0).cast("long"), *[_bit(_KINDS + n, F.col("org_type") == k) for n, k in enumerate(kinds or ())]),
    })


def _has(own: str) -> Column:
    return F.bit_count(F.col("applicant_bits").bitwiseAND(F.col(own)))


def _eligibility() -> Column:
    """The eligibility dimension by bits; null where both gates refuse, and at its best where the bits aren't known."""
    e = F.col("applicant_bits")
    first = F.when(_has("org_refused1") == 0, 10 + _has("org_own_type") * 5 + _has("org_own_501c3") * 3 + _has("org_own_small") * 2)
    second = F.when(_has("org_refused2") == 0, F.when(e.bitwiseAND(1 << 5) != 0, 15).otherwise(12 + _has("org_own_class") * 5 + _has("org_own_501c3") * 2 + _has("org_own_business")))
    return F.when(e.isNull(), 20).otherwise(F.greatest(first, second))


def _with_points_of_cases(mine: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds what an organization gets for each type and source, each kind of place, each complexity and wish for experience, in one list `points`, and the opportunities' places in it."""
    d, told = v2.dimension_points(), prefixed(own)
    types, geos = list(v2.TYPE_FIT), ([], ["-"], list(v2.US[:1]))
    by_type = [{"type": t, "source": s} for t in types for s in ("", "ted_eu")]
    by_place = [{"scope": s, "geo": g, "touched": t} for s in v2.SCOPES for g in geos for t in (False, True)]
    by_shape = [{"complexity": c, "wants_experience": w} for c in range(len(v2.COMPLEXITY)) for w in (False, True)]
    tables = (
        ("by_type", by_type, "type:string,source:string", js_round(v2.type_points() / 10 * 12) - v2.penalty_of("procurement_mismatch", "research_mismatch", "eu_procurement_barrier")),
        ("by_place", by_place, "scope:string,geo:array<string>,touched:boolean", js_round(5 + 0.5 * v2.geography(F.col("touched"))) - v2.penalty_of("geography_scope_mismatch")),
        ("by_shape", by_shape, "complexity:int,wants_experience:boolean", d["capacity_fit"] - v2.penalty_of("complexity_mismatch") + js_round(v1.maturity_points() / 5 * 4)),
    )
    for name, cases, kinds, points in tables:
        own = own.join(points_of_cases(told, name, cases, kinds, points).withColumnRenamed("org_id", "_of"), F.col("id") == F.col("_of")).drop("_of")
    own = own.withColumn("points", F.concat("by_type", "by_place", "by_shape")).drop("by_type", "by_place", "by_shape")  # one list, since a pair's row is as long as its columns
    flag = lambda when: F.when(when, 1).otherwise(0)
    place = lambda known, column: F.array_position(strings(known), F.col(column)).cast("int") - 1
    geo = F.when(F.arrays_overlap("geo", strings(v2.US)), 2).otherwise(flag(F.size("geo") > 0))
    at = {"type_at": place(types, "type") * 2 + flag(F.col("source") == "ted_eu"), "place_at": (place(v2.SCOPES, "scope") * len(geos) + geo) * 2 + len(by_type), "shape_at": F.col("complexity") * 2 + flag(F.col("wants_experience")) + len(by_type) + len(by_place)}
    return mine.withColumns({k: v.cast("int") for k, v in at.items()}), own


def bounded_sides(opps: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with what `bound` needs: bits and small numbers, and of the organizations lists of points that depend on little of an opportunity."""
    mine, own = sides(opps, orgs)
    mine, own = v2.with_place_bits(mine, staged(own, "organizations"))
    mine, own = _with_applicant_bits(mine, _with_token_bits(own))
    mine, own = _with_points_of_cases(mine, own)
    return mine, staged(own, "organizations")


def bound() -> Column:
    """No pair of bounded sides scores more; null where both gates reject it. V1's geography counts as at its best.

    The lists of bits, whose length is free, also keep it out of whole-stage code. There, with single numbers, the last pass over 0.51 GB took 103 s of tasks instead of 22, presumably as one method too long for Java to compile.
    """
    first, second = v1.points_v1(_hits(), F.col("org_unique")), v2.dimension_points()
    flags = F.coalesce(_has("org_own_501c3") * 2 + _has("org_own_business") * 2, F.lit(4))
    touched = F.when(F.col("org_place_bits").bitwiseAND(F.col("place_bits")) == 0, 0).otherwise(1)
    points = F.get("org_points", F.col("type_at")) + F.get("org_points", F.col("place_at") + touched) + F.get("org_points", F.col("shape_at"))
    points = points + _mission(first["mission_topic_fit"], second["domain_fit"]) + js_round(second["activity_fit"] / 15 * 10) + js_round(second["population_fit"] / 10 * 5)
    points = points + _funding(first["funding_size_fit"], second["funding_fit"]) + v2.semantic_boost(flags) - v2.penalty_of("funding_capacity_mismatch")
    return (points + _eligibility()).cast("int")


def score_hybrid(pairs: DataFrame) -> DataFrame:
    """Adds the eight blended dimensions, both boosts, penalty_total, total and passes_eligibility.

    A pair fails only if both scorers' gates reject it; it then scores 0 everywhere. One that either gate lets through takes the better eligibility.
    """
    first, second = v1.points_v1(), v2.dimension_points()
    out = v1.with_hits(pairs).withColumns({f"v1_{k}": v for k, v in first.items()} | {f"v2_{k}": v for k, v in second.items()})
    out = out.withColumn("v1_eligibility_fit", F.when(v1.passes_eligibility(), F.col("v1_eligibility_fit")).otherwise(0)).withColumn("v2_eligibility_fit", F.when(v2.passes(), F.col("v2_eligibility_fit")).otherwise(0))
    out = out.withColumn("passes_eligibility", (F.col("v1_eligibility_fit") > 0) | v2.passes())
    c = F.col
    blend = {
        "mission_domain": _mission(c("v1_mission_topic_fit"), c("v2_domain_fit")),
        "eligibility": F.least(F.lit(20), F.greatest("v1_eligibility_fit", "v2_eligibility_fit")),
        "org_type_fit": js_round(c("v2_organization_type_fit") / 10 * 12),
        "activity_fit": js_round(c("v2_activity_fit") / 15 * 10),
        "geography_fit": js_round(0.5 * c("v1_geography_fit") + 0.5 * c("v2_geography_fit")),
        "capacity_fit": c("v2_capacity_fit"),
        "funding_fit": _funding(c("v1_funding_size_fit"), c("v2_funding_fit")),
        "population_fit": js_round(c("v2_population_fit") / 10 * 5),
        "semantic_boost": v2.semantic_boost(),
        "maturity_boost": js_round(c("v1_maturity_fit") / 5 * 4),
    }
    ok = c("passes_eligibility")
    out = out.withColumns({k: F.when(ok, v).otherwise(0).cast("long") for k, v in blend.items()})
    out = out.withColumn("penalty_total", F.when(ok, _penalty()).otherwise(0).cast("long"))
    base = sum((c(d) for d in DIMENSIONS[1:]), c(DIMENSIONS[0])) + c("semantic_boost") + c("maturity_boost")
    return out.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), base - c("penalty_total")))).drop("hits")
