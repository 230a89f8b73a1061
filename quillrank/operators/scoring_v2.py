"""The profile scorer (V2): organizations and opportunities become profiles of tags and bands, and profiles are compared in eight dimensions.

Profiles are derived once on each side, before pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ACTIVITIES, POPULATIONS, SECTORS, bits, every_word, tags, tags_at
from ..functions.phrases import found_parts
from ..functions.text import js_round, strings
from .bounds import class_points, with_class_points
from .pairs import CLASSES, pair_up, said_by, spread

#: How well each class of organization (columns, in the order of CLASSES) suits each type of opportunity.
TYPE_FIT = {
    "program_service_grant": (10, 4, 6, 9, 10, 6, 5, 9, 7),
    "capacity_building_grant": (10, 6, 7, 8, 10, 6, 5, 8, 7),
    "technical_assistance": (9, 6, 7, 8, 9, 7, 8, 8, 6),
    "planning_grant": (8, 5, 6, 10, 10, 6, 6, 7, 6),
    "fellowship_training": (7, 4, 10, 5, 6, 9, 3, 6, 5),
    "research_grant": (5, 8, 10, 5, 6, 10, 4, 6, 5),
    "prize_challenge": (6, 9, 7, 5, 5, 7, 4, 5, 6),
    "international_implementation": (7, 4, 6, 6, 4, 6, 6, 10, 5),
    "procurement_contract": (3, 10, 4, 9, 5, 4, 10, 4, 4),
    "infrastructure_capital": (4, 5, 4, 10, 8, 4, 9, 5, 4),
    "loan_financing": (4, 8, 3, 5, 5, 3, 5, 4, 4),
    "other": (6, 5, 6, 6, 7, 5, 5, 6, 5),
}
#: Applicant types that each class satisfies.
ALIASES = {
    "nonprofit": ("nonprofit", "501c3", "community_based_org", "community_org", "ngo", "charity", "foundation"),
    "small_business": ("small_business", "for_profit", "8a_certified", "minority_owned", "woman_owned"),
    "university": ("university", "higher_education", "academic_institution", "nonprofit", "educational_institution"),
    "government": ("government", "public_agency", "local_government", "state_government", "tribal_government", "federal_agency"),
    "tribal": ("tribal", "tribal_government", "native_american", "alaska_native", "nonprofit", "government", "public_agency"),
    "research_institution": ("nonprofit", "university", "research_institution", "higher_education"),
    "contractor": ("small_business", "for_profit", "8a_certified"),
    "international_ngo": ("nonprofit", "international", "ngo"),
}
DIMENSIONS = ("eligibility_fit", "domain_fit", "activity_fit", "population_fit", "geography_fit", "organization_type_fit", "capacity_fit", "funding_fit")
BANDS = ("early", "growing", "established", "enterprise")
SCOPES = ("international", "national", "state", "local", "unknown")
US = ("united states", "us", "usa", "national", "u.s.")
COMPLEXITY = ("low", "medium", "high", "very_high")


def has(text: Column, *words: str) -> Column:
    """Whether the text contains one of the words."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def band(x: Column, *limits: float) -> Column:
    """How many of the ascending limits x reaches."""
    return sum((F.when(x >= lim, 1).otherwise(0) for lim in limits), F.lit(0))


def _scope(geo: Column, world: str) -> Column:
    text = F.lower(F.array_join(geo, " "))
    return (
        F.when(has(text, "international", "global", world), "international")
        .when(has(text, "national", "united states", "nationwide") | text.isin("us", "usa"), "national")
        .when(F.size(geo) == 0, "unknown")
        .when(F.exists(geo, lambda g: F.length(g) > 2), "state")
        .otherwise("local")
    )


def org_class() -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("mission", F.lit("")), F.array_join("keywords", " "), F.array_join("program_areas", " ")))
    kind, world = F.col("org_type"), has(text, "international", "global", "overseas")
    native = has(text, "tribal", "native american")
    return (
        F.when(kind.isin("small_business", "university"), kind)
        .when(kind.isin("government", "nonprofit") & (native | text.contains("indigenous")), "tribal")
        .when(kind == "government", "government")
        .when((kind == "nonprofit") & (has(text, "research", "science", "lab") | F.exists("keywords", lambda k: F.lower(k) == "study")), "research_institution")
        .when((kind == "nonprofit") & world, "international_ngo")
        .when(kind == "nonprofit", "nonprofit")
        .when(native, "tribal")
        .when(has(text, "university", "college", "academic"), "university")
        .when(has(text, "contract", "consulting firm", "professional services"), "contractor")
        .when(world, "international_ngo")
        .otherwise("other")
    )


def org_profiles(orgs: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    """Adds class, tags, geography scope, capacity band (null if unknown) and readiness for research and procurement."""
    text = F.concat_ws(" ", "mission", F.array_join("program_areas", " "), F.array_join("keywords", " "), F.array_join("population_served", " "))
    budget = F.when(F.col("annual_budget") > 0, F.col("annual_budget"))
    years = F.when(F.col("years_in_operation") >= 0, F.col("years_in_operation"))
    level = F.greatest(F.when(budget.isNotNull(), band(budget, 1e5, 5e5, 5e6)), F.when(years.isNotNull(), band(years, 2, 5, 15)))
    geo = F.filter("geography", lambda g: g.isNotNull() & (g != ""))
    out = orgs.select(
        "*",
        org_class().alias("class"),
        tags(text, sectors).alias("sectors"),
        tags(text, ACTIVITIES).alias("activities"),
        tags(F.concat_ws(" ", "mission", F.array_join("population_served", " ")), POPULATIONS).alias("populations"),
        F.transform(geo, F.lower).alias("geo"),
        _scope(geo, "overseas").alias("scope"),
        level.alias("capacity"),
        budget.alias("budget"),
        F.exists("keywords", lambda k: F.lower(k).isin("research", "science", "lab", "study", "data", "analysis")).alias("_science"),
    )
    small = F.col("is_small_business") | (F.col("class") == "government")
    procurement = F.when(F.col("class") == "contractor", "high").when(small & (F.coalesce(F.col("capacity"), F.lit(9)) != 0), "medium").otherwise("low")
    research = F.when(F.col("class").isin("research_institution", "university"), "high").when(F.col("_science"), "medium").otherwise("low")
    return _with_bits(out, sectors).withColumn("procurement_readiness", procurement).withColumn("research_readiness", research).drop("_science")


def _with_bits(rows: DataFrame, sectors: dict[str, list[str]]) -> DataFrame:
    """Adds the tags as bits, which pairs are compared by."""
    return rows.withColumns({f"{k}_bits": bits(k, list(names)) for k, names in (("sectors", sectors), ("activities", ACTIVITIES), ("populations", POPULATIONS))})


#: What is looked for in title and description besides tags, 63 words at most.
BODY_WORDS = (
    "procurement", "contract", "prize", "challenge", "competition", "fellowship", "internship", "research", "laboratory", "scientific study", "clinical study", "infrastructure", "capital project", "construction", "international",
    "overseas", "global development", "technical assistance", " ta ", "capacity", "build", "planning", "feasibility", "assessment", "training", "workforce", "solicitation", "rfp", "prior federal", "past performance",
    "cooperative agreement", "multi-site", "compliance", "reporting requirements", "environmental review", "audit", "experience", "established", "track", "record", "prior", "federal",
)


def said(*words: str) -> Column:
    """Whether title and description, joined and lower-cased, contain one of the words, which must be among BODY_WORDS; over the rows of `read_texts`."""
    return F.col("_said").bitwiseAND(F.lit(sum(1 << BODY_WORDS.index(w) for w in words))) != 0


def opportunity_type() -> Column:
    source, kind = F.lower(F.coalesce("source", F.lit(""))), F.col("funding_type")
    return (
        F.when(source.isin("sam_gov", "ted_eu"), "procurement_contract")
        .when(source == "sbir", "research_grant")
        .when(source == "world_bank", F.when(said("procurement", "contract"), "procurement_contract").otherwise("international_implementation"))
        .when(kind.isin("contract", "procurement"), "procurement_contract")
        .when(kind == "fellowship", "fellowship_training")
        .when(kind == "loan", "loan_financing")
        .when(said("prize", "challenge", "competition"), "prize_challenge")
        .when(said("fellowship", "internship"), "fellowship_training")
        .when(said("research", "laboratory", "scientific study", "clinical study"), "research_grant")
        .when(said("infrastructure", "capital project", "construction"), "infrastructure_capital")
        .when(said("international", "overseas", "global development"), "international_implementation")
        .when(said("technical assistance", " ta "), "technical_assistance")
        .when(said("capacity") & said("build"), "capacity_building_grant")
        .when(said("planning", "feasibility", "assessment"), "planning_grant")
        .when(said("training") & ~said("workforce"), "fellowship_training")
        .when(said("procurement", "solicitation", "rfp"), "procurement_contract")
        .otherwise("program_service_grant")
    )


def read_texts(opps: DataFrame, sectors: dict[str, list[str]] = SECTORS, tokens: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Reads an opportunity's texts in one pass: adds `_found`, the places of tag words, BODY_WORDS and tokens in a row, and `_said`, the BODY_WORDS as bits."""
    head = F.concat_ws(" ", F.lower("title"), F.lower("description"))
    out = opps.withColumn("_head", F.when(F.col("title").isNotNull() | F.col("description").isNotNull(), head))
    out = out.withColumn("_text", F.concat_ws(" ", "_head", F.lower(F.array_join("keywords", " ")), F.lower(F.array_join("categories", " "))))
    out = out.withColumn("_found", found_parts(F.col("_text"), F.coalesce(F.length("_head"), F.lit(0)), every_word(sectors, ACTIVITIES, POPULATIONS), BODY_WORDS, tokens)).drop("_head", "_text")
    first, one = len(every_word(sectors, ACTIVITIES, POPULATIONS)), F.lit(1).cast("long")
    own = F.filter("_found", lambda i: (i >= first) & (i < first + len(BODY_WORDS)))
    return out.withColumn("_said", F.aggregate(own, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", one, i - first))))


def tokens_read(tokens: list[str], sectors: dict[str, list[str]] = SECTORS) -> Column:
    """Which of the tokens given to `read_texts` the texts have; null where V1's tokens are: where a text, a list or an entry of one is null."""
    first = len(every_word(sectors, ACTIVITIES, POPULATIONS)) + len(BODY_WORDS)
    at = F.transform(F.filter("_found", lambda i: i >= first), lambda i: F.get(strings(tokens), i - first))
    whole = lambda words: F.col(words).isNotNull() & ~F.exists(words, lambda w: w.isNull())
    return F.when(F.col("title").isNotNull() & F.col("description").isNotNull() & whole("keywords") & whole("categories"), at)


def token_bits_read(tokens: list[str], sectors: dict[str, list[str]] = SECTORS) -> Column:
    """`tokens_read` as bits, 63 in each number of an array."""
    first, one = len(every_word(sectors, ACTIVITIES, POPULATIONS)) + len(BODY_WORDS), F.lit(1).cast("long")
    own = lambda c: F.filter("_found", lambda i: (i >= first + 63 * c) & (i < first + 63 * (c + 1)))
    numbers = [F.aggregate(own(c), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", one, (i - first) % 63))) for c in range(-(-len(tokens) // 63))]
    return F.when(tokens_read(tokens, sectors).isNotNull(), F.array(*numbers) if numbers else F.expr("cast(array() as array<bigint>)"))


def opp_profiles(opps: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    """Adds type, tags, applicant types, geography scope, and funding and complexity bands."""
    return profiled(read_texts(opps, sectors), sectors)


def profiled(read: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    """What `opp_profiles` adds, from the rows of `read_texts`."""
    geo = F.filter("geography", lambda g: g.isNotNull() & (g != ""))
    amount = F.coalesce("max_award", "min_award")
    out = read.select(
        "*",
        opportunity_type().alias("type"),
        F.transform("eligibility", F.lower).alias("elig"),
        F.transform(geo, F.lower).alias("geo"),
        _scope(geo, "worldwide").alias("scope"),
        F.when(amount.isNotNull(), band(amount, 25_000, 150_000, 1_000_000, 10_000_000)).alias("funding_band"),
    )
    first = len(every_word(sectors))
    out = out.withColumns({"sectors": tags_at(F.col("_found"), sectors), "activities": tags_at(F.col("_found"), ACTIVITIES, first), "populations": tags_at(F.col("_found"), POPULATIONS, first + len(every_word(ACTIVITIES)))}).drop("_found")
    point = lambda n, *words: F.when(said(*words), n).otherwise(0)
    by_type = F.when(F.col("type").isin("procurement_contract", "infrastructure_capital"), 3).when(F.col("type").isin("research_grant", "international_implementation"), 2).otherwise(0)
    points = by_type + F.coalesce(F.greatest(F.col("funding_band") - 1, F.lit(0)), F.lit(0))
    points = points + point(2, "prior federal", "past performance") + point(1, "cooperative agreement", "multi-site") + point(1, "international", "overseas") + point(1, "compliance", "reporting requirements") + point(1, "environmental review", "audit")
    e = F.col("elig")
    out = out.withColumns({"takes_501c3": F.array_contains(e, "501c3"), "takes_small": F.arrays_overlap(e, strings(("small_business", "for_profit")))})
    return _with_bits(out, sectors).withColumn("complexity", band(points, 2, 4, 6)).drop("_said")


def sides(opps: DataFrame, orgs: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> tuple[DataFrame, DataFrame]:
    return opp_profiles(spread(opps), sectors), org_profiles(orgs, sectors).withColumnRenamed("org_type", "kind")


def pairs(opps: DataFrame, orgs: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    return pair_up(*sides(opps, orgs, sectors))


def common(column: str) -> Column:
    """How many of sectors, activities or populations a pair has in common."""
    return F.bit_count(F.col(f"org_{column}_bits").bitwiseAND(F.col(f"{column}_bits")))


def either(column: str) -> Column:
    return F.bit_count(F.col(f"org_{column}_bits").bitwiseOR(F.col(f"{column}_bits")))


def refusals() -> dict[str, Column]:
    """The rules by which the gate refuses a class of organization, in the order in which they are told."""
    e, c = F.col("elig"), F.col("org_class")
    any_of = lambda *v: F.arrays_overlap(e, strings(v))
    nonprofit = any_of("nonprofit", "501c3", "community_based_org", "community_org") & ~any_of("for_profit", "small_business", "all") & ~c.isin("nonprofit", "tribal", "research_institution", "university")
    business = F.forall(e, lambda t: t.isin("small_business", "for_profit", "8a_certified")) & ~F.coalesce(F.col("org_is_small_business"), F.lit(False)) & ~c.isin("small_business", "contractor")
    exempt = any_of("501c3") & ~F.coalesce(F.col("org_has_501c3"), F.lit(False)) & ~c.isin("government", "university", "tribal")
    return {"nonprofit_only": nonprofit, "small_business_only": business, "501c3_required": exempt}


def passes() -> Column:
    """The eligibility gate by class of organization; no applicant types admit everyone."""
    nonprofit, business, exempt = refusals().values()
    return (F.size("elig") == 0) | ~(nonprofit | business | exempt)


def eligibility_points() -> Column:
    e = F.col("elig")
    any_of = lambda *v: F.arrays_overlap(e, strings(v))
    alias = F.lit(False)
    for c, values in ALIASES.items():
        alias = alias | ((F.col("org_class") == c) & any_of(*values))
    bonus = F.when(alias, 5).otherwise(0) + F.when(F.col("org_has_501c3") & any_of("501c3"), 2).otherwise(0) + F.when(F.col("org_is_small_business") & any_of("small_business", "for_profit"), 1).otherwise(0)
    return F.when(F.size(e) == 0, 12).when(any_of("all"), 15).otherwise(F.least(F.lit(20), 12 + bonus))


def type_points() -> Column:
    """What the type of opportunity is worth to the organization's class."""
    fit = F.lit(5)
    for kind, row in TYPE_FIT.items():
        of_class = F.lit(5)
        for c, v in zip(CLASSES, row, strict=True):
            of_class = F.when(F.col("org_class") == c, v).otherwise(of_class)
        fit = F.when(F.col("type") == kind, of_class).otherwise(fit)
    return fit


def geography(touching: Column) -> Column:
    """The geography dimension, given whether a place of one side lies in the name of one of the other."""
    us = F.arrays_overlap("org_geo", strings(("united states", "us", "usa", "u.s."))) & F.arrays_overlap("geo", strings(US))
    scope, own = F.col("scope"), F.col("org_scope")
    return (
        F.when(scope.isin("international", "unknown"), 7)
        .when((scope == "national") & own.isin("national", "state", "local"), 10)
        .when((scope == "national") & (own == "international"), 5)
        .when((F.size("geo") > 0) & (F.size("org_geo") > 0), F.when(touching | us, 10).otherwise(2))
        .when(own == scope, 9)
        .otherwise(5)
    )


def dimension_points() -> dict[str, Column]:
    """The eight dimensions over a pair's columns."""
    none = lambda column: F.col(f"{column}_bits") == 0
    m, n, k = common("sectors"), none("org_sectors"), none("sectors")
    jaccard = m / F.greatest(either("sectors"), F.lit(1))
    domain = F.when(n & k, 8).when(n | k, 6).when(m == 0, 0).when(m >= 4, 20).when(m == 3, 17).when(m == 2, js_round(12 + jaccard * 8)).otherwise(js_round(8 + jaccard * 8))
    a, p = common("activities"), common("populations")
    activity = F.when(none("org_activities") | none("activities"), 6).when(a == 0, 2).when(a >= 3, 15).when(a == 2, 11).otherwise(7)
    population = F.when(none("org_populations") | none("populations"), 5).when(p == 0, 2).when(p >= 2, 10).otherwise(6)

    touching = F.exists("org_geo", lambda o: F.exists("geo", lambda q: o.contains(q) | q.contains(o)))
    gap = F.col("complexity") - F.col("org_capacity")
    capacity = F.when(gap.isNull(), 6).when(gap <= 0, 10).when(gap == 1, 6).when(gap == 2, 3).otherwise(1)
    budget, most, least = F.col("org_budget"), F.col("max_award"), F.coalesce("min_award", F.lit(0))
    low, high = budget * 0.05, budget * 3.0
    funding = (
        F.when(budget.isNull() | most.isNull(), 3)
        .when((most >= low) & (least <= high), 5)
        .when((most >= low * 0.4) & (least <= high * 2), 3)
        .when((most < budget * 0.01) | (least > budget * 5), 1)
        .otherwise(2)
    )
    return dict(zip(DIMENSIONS, (eligibility_points(), domain, activity, population, geography(touching), type_points(), capacity, funding), strict=True))


def semantic_boost(flags: Column | None = None) -> Column:
    """The boost over a pair's columns; `flags` are the points for tax exemption and small businesses, if they are known otherwise."""
    m, p, a = common("sectors"), common("populations"), common("activities")
    step = lambda x: F.when(x >= 2, 2).otherwise(x)
    points = F.when(m >= 4, 4).when(m == 3, 3).when(m == 2, 2).otherwise(0) + step(p) + step(a)
    if flags is None:
        flags = F.when(F.col("org_has_501c3") & F.col("takes_501c3"), 2).otherwise(0) + F.when(F.col("org_is_small_business") & F.col("takes_small"), 2).otherwise(0)
    return F.least(F.lit(10), points + flags)


def penalty_rules() -> dict[str, tuple[Column, Column]]:
    """When each penalty applies and its value."""
    c, kind = F.col("org_class"), F.col("type")
    gap = F.col("complexity") - F.col("org_capacity")
    return {
        "complexity_mismatch": (gap > 0, F.when(gap == 1, 3).when(gap == 2, 7).otherwise(10)),
        "procurement_mismatch": ((kind == "procurement_contract") & (F.col("org_procurement_readiness") == "low") & ~c.isin("government", "contractor", "small_business"), F.lit(8)),
        "research_mismatch": ((kind == "research_grant") & (F.col("org_research_readiness") == "low") & ~c.isin("university", "research_institution"), F.lit(5)),
        "geography_scope_mismatch": (F.col("scope").isin("local", "state") & (F.col("org_scope") == "international"), F.lit(5)),
        "funding_capacity_mismatch": (F.col("min_award") > F.col("org_budget") * 5, F.lit(5)),
        "eu_procurement_barrier": ((F.col("source") == "ted_eu") & ~c.isin("contractor", "small_business", "government", "university"), F.lit(5)),
    }


def penalties() -> Column:
    """array<struct<type, value>> of the penalties that apply."""
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("type"), value.cast("int").alias("value"))) for name, (when, value) in penalty_rules().items()]))


def penalty_of(*names: str) -> Column:
    """The sum of those of the named penalties that apply."""
    rules = penalty_rules()
    return sum((F.when(rules[n][0], rules[n][1]).otherwise(0) for n in names[1:]), F.when(rules[names[0]][0], rules[names[0]][1]).otherwise(0))


def with_place_bits(mine: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the organizations' places as bits: those of an organization, and those that an opportunity's places touch; null where there are too many for a number."""
    said = said_by(own, "geo")
    none = F.lit(None).cast("long")
    if said is None or len(said) > 63:
        return mine.withColumn("place_bits", none), own.withColumn("place_bits", none)
    touched = F.filter(strings(said), lambda o: F.exists("geo", lambda q: o.contains(q) | q.contains(o)))
    return mine.withColumn("place_bits", bits(touched, said)), own.withColumn("place_bits", bits("geo", said))


def best_places() -> Column:
    """The geography dimension by the bits of places, at its best where those aren't known."""
    return geography(F.coalesce(F.col("org_place_bits").bitwiseAND(F.col("place_bits")) != 0, F.lit(True)))


def bounded_sides(opps: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with what `bound` needs."""
    mine, own = with_place_bits(*sides(opps, orgs))
    european = F.when((F.col("source") == "ted_eu") & ~F.col("org_class").isin("contractor", "small_business", "government", "university"), 5).otherwise(0)
    return with_class_points(mine, passes(), eligibility_points() + type_points() - european), own


def bound() -> Column:
    """No pair of bounded sides scores more. The flags of the organization count as at their best."""
    d, gap = dimension_points(), F.col("complexity") - F.col("org_capacity")
    points = class_points() + best_places() + sum((d[k] for k in ("activity_fit", "population_fit", "capacity_fit", "funding_fit")), d["domain_fit"])
    return points + semantic_boost() - F.when(gap == 1, 3).when(gap == 2, 7).when(gap > 2, 10).otherwise(0)


def score_v2(pairs: DataFrame) -> DataFrame:
    """Adds the dimensions, base_score, semantic_boost, penalties, penalty_total, total and passes_eligibility; failing pairs score 0 and have no penalties."""
    ok = F.col("passes_eligibility")
    out = pairs.withColumn("passes_eligibility", passes())
    out = out.withColumns({k: F.when(ok, v).otherwise(0).cast("long") for k, v in dimension_points().items()})
    out = out.withColumn("base_score", sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])))
    out = out.withColumn("semantic_boost", F.when(ok, semantic_boost()).otherwise(0).cast("long"))
    out = out.withColumn("penalties", F.when(ok, penalties()).otherwise(F.expr("cast(array() as array<struct<type:string,value:int>>)")))
    out = out.withColumn("penalty_total", F.aggregate("penalties", F.lit(0), lambda s, p: s + p["value"]).cast("long"))
    return out.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), F.col("base_score") + F.col("semantic_boost") - F.col("penalty_total"))))
