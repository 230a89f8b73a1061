"""The specificity-first scorer (V3): exact concept phrases, centrality, specific populations and the intended applicant outweigh generic overlap.

As in the other scorers, text features are derived once on each side, before pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import SECTORS
from ..functions.phrases import contained
from ..functions.text import js_round, norm_joined, norm_text, strings
from . import scoring_v2 as v2
from . import scoring_v4 as v4
from .bounds import class_points, with_class_points
from .pairs import only, pair_up, said_by, spread
from .scoring_v2 import has

#: Concept phrases of value, the most specific ones of each field first.
PHRASES = (
    "black maternal health", "maternal mortality", "maternal morbidity", "maternal health", "birth equity", "reproductive health", "birth outcomes", "prenatal care", "postpartum care", "obstetric care", "midwifery",
    "perinatal health", "neonatal health", "infant mortality", "pregnancy outcomes", "pregnant people", "pregnant women", "family planning", "reproductive justice", "doula services",
    "racial equity", "racial justice", "health disparities", "health inequities", "social determinants", "structural racism", "implicit bias", "black women", "black youth", "black communities", "black men",
    "indigenous peoples", "native communities", "tribal nations", "latino communities", "asian american", "pacific islander", "hbcu", "minority serving institution", "minority owned",
    "first generation", "english learner", "immigrant communities",
    "mental health", "behavioral health", "substance use disorder", "opioid crisis", "addiction treatment", "recovery support", "trauma informed", "violence prevention", "domestic violence",
    "sexual assault", "gun violence", "community violence", "suicide prevention", "crisis intervention", "peer support", "chronic disease", "diabetes prevention", "cancer screening",
    "hiv prevention", "tuberculosis", "infectious disease", "oral health", "dental care", "vision care", "food insecurity", "food security", "hunger relief", "food desert",
    "disability services", "independent living", "assistive technology",
    "workforce development", "job training", "career pathway", "workforce training", "career development", "job placement", "apprenticeship program", "work readiness", "economic mobility",
    "small business development", "entrepreneurship training", "microenterprise", "minority business", "women owned business",
    "affordable housing", "housing instability", "housing insecurity", "homelessness prevention", "transitional housing", "permanent supportive housing",
    "community development", "neighborhood revitalization", "community land trust", "financial literacy", "asset building", "wealth building",
    "clean energy", "renewable energy", "energy efficiency", "climate resilience", "climate adaptation", "climate justice", "environmental justice", "clean water", "air quality",
    "solar energy", "green infrastructure", "carbon reduction",
    "early childhood education", "early learning", "school readiness", "literacy program", "adult literacy", "college access", "college readiness", "stem education", "afterschool program", "summer learning",
    "special education", "inclusive education",
    "public health workforce", "community health worker", "health navigator", "community health center", "federally qualified health center", "rural health", "telehealth", "telemedicine", "health equity",
    "digital equity", "digital inclusion", "broadband access", "technology access", "data privacy", "cybersecurity",
    "criminal justice reform", "reentry services", "legal aid", "civil rights", "voting rights", "immigration services", "refugee resettlement", "asylum seekers",
)
#: Words that carry little meaning in this field.
GENERIC = (
    "health community support outcomes improve innovation services equity development research program project initiative work provide need build help service "
    "data fund grant award capacity impact resource local national public access benefit plan system organization address population underserved diverse "
    "strengthen increase reduce partner engage promote activity opportunity challenge solution approach strategy model framework outcome result goal"
).split()
#: Populations by how specific they are.
POPULATIONS = {
    4: ("black women", "black maternal", "pregnant people", "pregnant women", "pregnant individuals", "black youth", "black men", "black girls", "black boys", "indigenous women", "native women", "latina women",
        "undocumented immigrants", "asylum seekers", "trafficking survivors", "domestic violence survivors", "formerly incarcerated", "returning citizens", "people with disabilities", "people with hiv",
        "people who use drugs", "transgender women", "lgbtq youth", "queer youth", "infants and toddlers", "newborns"),
    3: ("black communities", "african american", "indigenous peoples", "native american", "latino communities", "hispanic communities", "asian american", "pacific islander", "refugee", "immigrants", "veterans",
        "justice involved", "homeless individuals", "houseless", "rural communities", "tribal members", "elderly", "older adults", "children", "youth", "adolescents", "young people", "survivors", "caregivers",
        "single parents", "foster youth"),
    2: ("women", "men", "families", "low income", "low-income", "marginalized communities", "vulnerable populations", "underserved communities", "underserved populations", "disadvantaged", "minority", "minorities",
        "people of color", "bipoc"),
    1: ("general public", "community members", "community", "residents", "individuals", "all"),
}
#: Applicant types that satisfy each class, and those that exclude it.
SATISFIES = {
    "nonprofit": ("nonprofit", "501c3", "community_based_org", "community_org", "ngo", "charity", "foundation", "nonprofit_organization", "community_nonprofit", "health_center"),
    "small_business": ("small_business", "for_profit", "8a_certified", "minority_owned", "woman_owned", "disadvantaged_business", "hubzone", "veteran_owned", "sdvosb"),
    "university": ("university", "higher_education", "academic_institution", "nonprofit", "educational_institution", "college", "community_college", "hbcu", "msi", "tribal_college"),
    "government": ("government", "public_agency", "local_government", "state_government", "tribal_government", "federal_agency", "municipal", "county"),
    "tribal": ("tribal", "tribal_government", "native_american", "alaska_native", "nonprofit", "government", "public_agency", "tribal_college", "indigenous"),
    "research_institution": ("nonprofit", "university", "research_institution", "higher_education", "academic", "scientific", "laboratory", "institute"),
    "contractor": ("small_business", "for_profit", "8a_certified", "minority_owned", "veteran_owned"),
    "international_ngo": ("nonprofit", "international", "ngo", "international_ngo", "nonprofit_organization"),
    "other": ("all",),
}
EXCLUDES = {
    "nonprofit": ("small_business", "for_profit", "8a_certified", "contractor"),
    "small_business": ("nonprofit", "501c3", "university", "higher_education"),
    "university": ("small_business", "for_profit", "contractor"),
    "government": ("small_business", "for_profit", "nonprofit"),
    "contractor": ("nonprofit", "501c3", "university", "higher_education"),
    "international_ngo": ("domestic_only", "us_organizations_only"),
}
#: Cues for the intended applicant, the first that occurs decides; types of opportunity count as cues.
CUES = (
    ("hbcu_institution", ("hbcu", "historically black college"), None),
    ("tribal", ("tribal college", "tribal nation", "native american"), None),
    ("research_university", ("university", "college", "higher education", "academic institution", "research institution", "principal investigator"), "research_grant"),
    ("contractor", ("vendor", "contractor", "solicitation", "rfp", "rfq"), "procurement_contract"),
    ("government", ("government agency", "public agency", "local government", "state agency", "municipal"), None),
    ("small_business", ("small business", "startup", "entrepreneur", "for-profit"), None),
    ("community_nonprofit", ("community nonprofit", "community-based", "nonprofit organization", "501(c)(3)", "community organization"), None),
    ("healthcare_provider", ("healthcare provider", "health center", "hospital", "clinic", "federally qualified"), None),
    ("nonprofit", ("nonprofit", "ngo", "charity", "foundation"), None),
)
DIMENSIONS = ("concept_fit", "concept_centrality", "activity_fit", "population_fit", "target_applicant_fit", "eligibility", "geography_fit", "capacity_fit", "funding_fit")
PENALTIES = ("genericity", "weak_specificity", "target_applicant_mismatch", "population_mismatch", "complexity_mismatch", "procurement_barrier", "eu_barrier", "funding_capacity_mismatch")


def intended_applicant() -> Column:
    text, out = F.lower(F.concat_ws(" ", "title", "description", F.array_join("eligibility", " "))), F.lit("open")
    for who, words, kind in reversed(CUES):
        out = F.when(has(text, *words) | (F.col("type") == kind) if kind else has(text, *words), who).otherwise(out)
    return out


def opp_features(opps: DataFrame, phrases: tuple[str, ...] = PHRASES, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    title, body = F.col("title_norm"), F.col("body_norm")  # once for all that is made of them
    out = v2.opp_profiles(opps, sectors).withColumns({"title_norm": norm_text(F.col("title")), "body_norm": norm_text(F.col("description"))})
    return out.select(
        "*",
        intended_applicant().alias("intended"),
        contained(norm_joined(title, body, norm_text(F.array_join("keywords", " ")), norm_text(F.array_join("categories", " "))), phrases).alias("phrases"),
        contained(title, phrases).alias("title_phrases"),
        contained(norm_text(F.substring("description", 1, 350)), phrases).alias("opening_phrases"),
        F.filter(F.split(norm_joined(title, body), " "), lambda t: F.length(t) > 2).alias("words"),
        v4.population_tags(norm_text(F.concat_ws(" ", "title", F.substring("description", 1, 500))), POPULATIONS).alias("pops"),
    )


def org_features(orgs: DataFrame, phrases: tuple[str, ...] = PHRASES, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    """Adds `phrases` of all an organization's texts and `core`, those of its mission and keywords alone."""
    text = norm_text(F.concat_ws(" ", "mission", F.array_join("keywords", " "), F.array_join("program_areas", " ")))
    return v2.org_profiles(orgs, sectors).select(
        "*",
        contained(text, phrases).alias("phrases"),
        contained(norm_text(F.concat_ws(" ", "mission", F.array_join("keywords", " "))), phrases).alias("core"),
        F.array_distinct(F.split(text, " ")).alias("words"),
        v4.population_tags(norm_text(F.concat_ws(" ", "mission", F.array_join("population_served", " "))), POPULATIONS).alias("pops"),
    )


def sides(opps: DataFrame, orgs: DataFrame, phrases: tuple[str, ...] = PHRASES, sectors: dict[str, list[str]] = SECTORS) -> tuple[DataFrame, DataFrame]:
    """Both sides' features; of an opportunity's words only those that some organization says."""
    own = org_features(orgs, phrases, sectors)
    return opp_features(spread(opps), phrases, sectors).withColumn("words", only("words", said_by(own, "words"))), own


def pairs(opps: DataFrame, orgs: DataFrame, phrases: tuple[str, ...] = PHRASES, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    return pair_up(*sides(opps, orgs, phrases, sectors))


def excluded() -> Column:
    """Whether applicant types exclude the class."""
    out = F.lit(False)
    for kind, types in EXCLUDES.items():
        out = out | ((F.col("org_class") == kind) & F.arrays_overlap("elig", strings(types)))
    return out


def passes() -> Column:
    """The strict gate: the source-aware scorer's rules, and applicant types that exclude the class."""
    return (F.size("elig") == 0) | (v4.passes() & ~excluded())


def _matches(out: DataFrame) -> DataFrame:
    """Adds what a pair has in common: phrases, domains, words, populations and the share of specific words among the common ones."""
    shared = (("exact", "org_phrases", "phrases"), ("in_title", "org_core", "title_phrases"), ("in_opening", "org_core", "opening_phrases"))
    out = out.withColumns({k: F.size(F.array_intersect(a, b)) for k, a, b in shared} | {"domains": v2.common("sectors")}).withColumns({"shared_pops": F.array_intersect("pops", "org_pops"), "matched": F.filter("words", lambda t: F.array_contains("org_words", t))})
    special = F.size(F.filter("matched", lambda t: ~t.isin(*GENERIC) & (F.length(t) > 3)))
    return out.withColumn("specific", F.when(F.size("matched") > 0, special / F.size("matched")).otherwise(0.0))


def _concept(exact: Column, domains: Column) -> Column:
    by_phrase = F.when(exact >= 3, 20).when(exact == 2, 16).when(exact == 1, 11).when((F.size("org_phrases") > 0) & (F.size("phrases") > 0), 4).otherwise(0)
    return by_phrase + F.when(domains >= 3, 8).when(domains == 2, 6).when(domains == 1, 3).otherwise(0)


def _capacity(second: dict[str, Column]) -> Column:
    return js_round(F.when((F.col("complexity") - F.col("org_capacity")).isNull(), 4).otherwise(second["capacity_fit"]) / 10 * 7)


def _funding(second: dict[str, Column]) -> Column:
    return js_round(F.when(F.col("org_budget").isNull() | F.col("max_award").isNull(), 2).otherwise(second["funding_fit"]) / 5 * 6)


def _named(level: Column, several: Column, otherwise: Column) -> Column:
    """Points of the populations in common by the most specific level among them."""
    return F.when(level == 4, 7 + several).when(level == 3, 5 + several).when(level == 2, 3 + several).when(level == 1, 2).otherwise(otherwise)


def _weak(none: Column, concept: Column, central: Column) -> Column:
    return F.when((~none & (central >= 4)) | (concept >= 18), 0).when((concept < 8) & (central < 4), 8).when((concept < 12) & (central == 0), 4).otherwise(0)


def _complex() -> Column:
    gap = F.col("complexity") - F.col("org_capacity")
    return js_round(F.when(gap == 1, 3).when(gap == 2, 7).when(gap >= 3, 10).otherwise(0) / 10 * 7)


def _procurement() -> Column:
    return F.when((F.col("type") == "procurement_contract") & ~F.col("org_class").isin("contractor", "small_business", "government"), 8).otherwise(0)


def _european() -> Column:
    return F.when((F.col("source") == "ted_eu") & ~F.col("org_class").isin("contractor", "small_business", "government", "university"), 4).otherwise(0)


def _too_large() -> Column:
    return F.when(F.col("min_award") > F.col("org_budget") * 5, 5).otherwise(0)


def bounded_sides(opps: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with what `bound` needs."""
    mine, own = sides(opps, orgs)
    fit, mismatch = v4.target_applicant()
    points = v4.eligibility(SATISFIES) + fit - mismatch - _procurement() - _european()
    mine, own = v2.with_place_bits(*v4.with_phrase_bits(mine, own, PHRASES, "core"))
    return with_class_points(mine.withColumn("pop_level", v4.specificity(F.col("pops"), POPULATIONS)), passes(), points), own


def bound() -> Column:
    """No pair of bounded sides scores more. The words in common and the body's repetitions count as at their best."""
    c, size, second, hits = F.col, F.size, v2.dimension_points(), v4.hits
    exact, shared, in_title, in_opening = hits("org_phrase_bits", "phrase_bits"), hits("org_pop_bits", "pop_bits"), hits("org_core_bits", "title_bits"), hits("org_core_bits", "opening_bits")
    concept = F.least(F.lit(28), _concept(exact, v2.common("sectors")))
    central = F.when(in_title >= 2, 6).when(in_title == 1, 4).otherwise(2) + F.greatest(F.when(in_opening >= 2, 4).when(in_opening == 1, 2).otherwise(0), F.when(exact > 0, 3).otherwise(0))
    named = F.when(shared > 0, _named(c("pop_level"), F.when(shared >= 2, 1).otherwise(0), F.lit(3))).otherwise(3)
    population = F.when((size("org_pops") > 0) & (size("pops") > 0), named).when(v2.common("populations") > 0, 4).otherwise(2)
    points = class_points() + concept + F.least(F.lit(12), central) + F.least(F.lit(10), second["activity_fit"]) + population + js_round(v2.best_places() / 10 * 7) + _capacity(second) + _funding(second)
    return points + js_round(v2.semantic_boost() / 10 * 8) - _weak(exact == 0, concept, central) - _complex() - _too_large()


def _dimensions() -> dict[str, Column]:
    c, size, second = F.col, F.size, v2.dimension_points()
    exact, domains = c("exact"), c("domains")
    concept = _concept(exact, domains)
    concept = F.when((exact == 0) & (c("specific") < 0.3) & (concept > 3), concept - 3).otherwise(concept)

    title = F.when(c("in_title") >= 2, 6).when(c("in_title") == 1, 4).when(F.exists("org_sectors", lambda t: c("title_norm").contains(t)), 2).otherwise(0)
    first = F.try_element_at("org_core", F.lit(1))
    times = F.coalesce((F.length("body_norm") - F.length(F.replace(c("body_norm"), first, F.lit("")))) / F.length(first), F.lit(0.0))
    repeated = F.greatest(F.when(c("in_opening") >= 2, 4).when(c("in_opening") == 1, 2).otherwise(0), F.when(times >= 3, 3).otherwise(0))

    own, theirs, shared = c("org_pops"), c("pops"), size("shared_pops")
    partly = F.exists(own, lambda a: F.exists(theirs, lambda b: a.contains(b) | b.contains(a)))
    named = _named(v4.specificity(c("shared_pops"), POPULATIONS), F.when(shared >= 2, 1).otherwise(0), F.when(partly, 3).otherwise(1))
    by_tag = F.when(v2.common("populations") > 0, 4).otherwise(2)

    points = (
        F.least(F.lit(28), concept),
        F.least(F.lit(12), title + repeated),
        F.least(F.lit(10), second["activity_fit"]),
        F.when((size(own) > 0) & (size(theirs) > 0), named).otherwise(by_tag),
        v4.target_applicant()[0],
        v4.eligibility(SATISFIES),
        js_round(second["geography_fit"] / 10 * 7),
        _capacity(second),
        _funding(second),
    )
    return dict(zip(DIMENSIONS, points, strict=True))


def _penalties() -> dict[str, Column]:
    c = F.col
    none, vague, base = c("exact") == 0, 1 - c("specific"), c("base_score")
    generic = F.when(none & (c("specific") < 0.2) & (base > 30), F.least(F.lit(15), js_round(base * vague * 0.35))).when(none & (c("specific") < 0.35), F.least(F.lit(8), js_round(base * vague * 0.15))).otherwise(0)
    pointed = lambda tags: F.arrays_overlap(tags, strings(POPULATIONS[3] + POPULATIONS[4]))
    apart = (F.size("shared_pops") == 0) & (F.size("org_pops") > 0) & pointed(c("pops"))
    values = (
        generic,
        _weak(none, c("concept_fit"), c("concept_centrality")),
        v4.target_applicant()[1],
        F.when(apart, F.when(pointed(c("org_pops")), 6).otherwise(3)).otherwise(0),
        _complex(),
        _procurement(),
        _european(),
        _too_large(),
    )
    return dict(zip(PENALTIES, values, strict=True))


def score_v3(pairs: DataFrame) -> DataFrame:
    """Adds nine dimensions, semantic_boost, penalties by type, penalty_total, total and passes_eligibility; failing pairs score 0 and have no penalties."""
    c = F.col
    out = _matches(pairs).withColumn("passes_eligibility", passes())
    ok = c("passes_eligibility")
    out = out.withColumns({k: F.when(ok, v).otherwise(0).cast("long") for k, v in _dimensions().items()})
    out = out.withColumn("base_score", sum((c(d) for d in DIMENSIONS[1:]), c(DIMENSIONS[0])))
    out = out.withColumn("semantic_boost", F.when(ok, js_round(v2.semantic_boost() / 10 * 8)).otherwise(0).cast("long"))
    applied = F.array(*[F.struct(F.lit(k).alias("type"), F.when(ok, v).otherwise(0).cast("long").alias("value")) for k, v in _penalties().items()])
    out = out.withColumn("penalties", F.filter(applied, lambda p: p["value"] > 0))
    out = out.withColumn("penalty_total", F.aggregate("penalties", F.lit(0).cast("long"), lambda s, p: s + p["value"]))
    total = F.greatest(F.lit(0), F.least(F.lit(100), c("base_score") + c("semantic_boost") - c("penalty_total")))
    return out.withColumn("total", total).drop("exact", "domains", "in_title", "in_opening", "shared_pops", "matched")
