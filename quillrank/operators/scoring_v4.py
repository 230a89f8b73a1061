"""The source-aware scorer (V4): concept phrases, centrality, populations, intended applicant, regions, recency and source barriers.

Word-level and phrase-level features are derived once on each side; the pair-level part compares short arrays. `as_of` stands for the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import SECTORS, bits
from ..functions.phrases import contained
from ..functions.text import js_round, let, norm_joined, norm_text, parse_date, strings
from . import scoring_v2 as v2
from .bounds import class_points, with_class_points
from .pairs import only, pair_up, said_by, spread
from .scoring_v2 import has

#: Concept phrases of value, in their order (one of them comes twice).
CONCEPTS = (
    "black maternal health", "maternal mortality", "maternal morbidity", "maternal health", "birth equity", "reproductive health", "birth outcomes", "prenatal care", "postpartum care", "obstetric care", "midwifery",
    "perinatal health", "neonatal health", "infant mortality", "pregnancy outcomes", "pregnant people", "pregnant women", "family planning", "reproductive justice", "doula services",
    "racial equity", "racial justice", "health disparities", "health inequities", "social determinants", "structural racism", "implicit bias", "black women", "black youth", "black communities", "black men",
    "indigenous peoples", "native communities", "tribal nations", "latino communities", "asian american", "pacific islander", "hbcu", "minority serving institution", "minority owned",
    "first generation", "english learner", "immigrant communities",
    "mental health", "behavioral health", "substance use disorder", "opioid crisis", "addiction treatment", "recovery support", "trauma informed", "violence prevention", "domestic violence",
    "sexual assault", "gun violence", "community violence", "suicide prevention", "crisis intervention", "peer support", "chronic disease", "diabetes prevention", "cancer screening",
    "hiv prevention", "tuberculosis", "infectious disease", "oral health", "dental care", "vision care", "food insecurity", "food security", "hunger relief", "food desert",
    "disability services", "independent living", "assistive technology", "veteran health", "veteran services", "veteran housing",
    "workforce development", "job training", "career pathway", "workforce training", "career development", "job placement", "apprenticeship program", "work readiness", "economic mobility",
    "small business development", "entrepreneurship training", "microenterprise", "minority business", "women owned business", "women entrepreneurs", "startup funding", "seed capital",
    "angel investment", "venture capital", "business incubator",
    "affordable housing", "housing instability", "housing insecurity", "homelessness prevention", "transitional housing", "permanent supportive housing",
    "community development", "neighborhood revitalization", "community land trust", "financial literacy", "asset building", "wealth building", "community reinvestment", "place-based investment",
    "clean energy", "renewable energy", "energy efficiency", "climate resilience", "climate adaptation", "climate justice", "environmental justice", "clean water", "air quality",
    "solar energy", "green infrastructure", "carbon reduction", "carbon emissions", "carbon footprint", "sustainable technology", "water sanitation", "water access", "drinking water",
    "agricultural technology", "precision agriculture", "sustainable agriculture", "food systems", "local food", "farm to table",
    "early childhood education", "early learning", "school readiness", "literacy program", "adult literacy", "college access", "college readiness", "stem education", "afterschool program", "summer learning",
    "special education", "inclusive education", "arts education", "digital learning", "edtech", "learning platform", "coding education", "computer science education",
    "public health workforce", "community health worker", "health navigator", "community health center", "federally qualified health center", "rural health", "telehealth", "telemedicine", "health equity",
    "digital equity", "digital inclusion", "broadband access", "technology access", "data privacy", "cybersecurity", "government technology", "civic technology", "open data",
    "data infrastructure", "artificial intelligence", "machine learning",
    "criminal justice reform", "reentry services", "legal aid", "civil rights", "voting rights", "immigration services", "refugee resettlement", "asylum seekers", "legal services", "public defender", "access to justice",
    "public transit", "transportation equity", "mobility access", "transit-oriented development", "active transportation",
    "arts education", "cultural programs", "creative economy", "performing arts", "visual arts", "public art",
    "humanitarian aid", "disaster relief", "disaster recovery", "international development", "global health", "global development", "conflict affected", "fragile states", "emergency response",
)
#: Words that carry little meaning in this field.
GENERIC = (
    "health community support outcomes improve innovation services equity development research program project initiative work provide need build help service "
    "data fund grant award capacity impact resource local national public access benefit plan system organization address population underserved diverse "
    "strengthen increase reduce partner engage promote activity opportunity challenge solution approach strategy model framework outcome result goal "
    "technology platform digital tools education training"
).split()
#: Populations by how specific they are.
POPULATIONS = {
    4: ("black women", "black maternal", "pregnant people", "pregnant women", "black youth", "black men", "black girls", "black boys", "indigenous women", "native women", "latina women", "undocumented immigrants",
        "asylum seekers", "trafficking survivors", "domestic violence survivors", "formerly incarcerated", "returning citizens", "people with disabilities", "people with hiv", "lgbtq youth", "transgender women",
        "queer youth", "infants and toddlers", "newborns"),
    3: ("black communities", "african american", "indigenous peoples", "native american", "latino communities", "hispanic communities", "asian american", "pacific islander", "refugee", "immigrants", "veterans",
        "justice involved", "homeless individuals", "rural communities", "tribal members", "elderly", "older adults", "children", "youth", "adolescents", "young people", "survivors", "caregivers", "single parents",
        "foster youth", "farmers", "small business owners"),
    2: ("women", "men", "families", "low income", "low-income", "marginalized communities", "vulnerable populations", "underserved communities", "underserved populations", "disadvantaged", "minority", "minorities",
        "people of color", "bipoc", "entrepreneurs", "startups", "businesses", "homeowners", "students", "girls"),
    1: ("general public", "community members", "community", "residents", "individuals", "all", "public agencies", "municipalities", "urban communities"),
}
#: Names of states and regions.
REGIONS = {
    "california": ("ca", "california"), "texas": ("tx", "texas"), "ohio": ("oh", "ohio"), "illinois": ("il", "illinois"), "new york": ("ny", "new york"), "florida": ("fl", "florida"), "michigan": ("mi", "michigan"),
    "pennsylvania": ("pa", "pennsylvania"), "georgia": ("ga", "georgia"), "north carolina": ("nc", "north carolina"), "virginia": ("va", "virginia"), "washington": ("wa", "washington"), "arizona": ("az", "arizona"),
    "colorado": ("co", "colorado"), "maryland": ("md", "maryland"), "massachusetts": ("ma", "massachusetts"), "minnesota": ("mn", "minnesota"),
    "midwest": ("illinois", "ohio", "michigan", "indiana", "wisconsin", "minnesota", "iowa", "missouri", "north dakota", "south dakota", "nebraska", "kansas"),
    "southeast": ("florida", "georgia", "north carolina", "south carolina", "virginia", "alabama", "mississippi", "tennessee", "kentucky"),
    "united states": ("united states", "us", "usa", "national", "nationwide"), "global": ("global", "international", "worldwide"),
}
#: Classes that a source suits, classes that it bars, and the penalty.
SOURCES = {
    "sbir": (("small_business", "contractor"), ("nonprofit", "university", "government", "international_ngo"), 12),
    "sam_gov": (("small_business", "contractor", "government"), ("nonprofit", "university", "international_ngo"), 8),
    "ted_eu": (("contractor", "small_business", "international_ngo"), ("nonprofit", "government", "tribal"), 10),
    "world_bank": (("international_ngo", "university", "contractor"), ("nonprofit", "tribal"), 5),
    "threesixtygiving": (("international_ngo", "university", "nonprofit"), ("small_business", "contractor"), 6),
    "simpler_grants": (("nonprofit", "university", "government", "tribal"), (), 0),
    "grants_gov": (("nonprofit", "university", "government", "tribal", "research_institution"), (), 0),
}
#: Applicant types that satisfy each class.
SATISFIES = {
    "nonprofit": ("nonprofit", "501c3", "community_based_org", "community_org", "ngo", "charity", "foundation", "nonprofit_organization", "community_nonprofit", "health_center"),
    "small_business": ("small_business", "for_profit", "8a_certified", "minority_owned", "woman_owned", "disadvantaged_business", "hubzone", "veteran_owned"),
    "university": ("university", "higher_education", "academic_institution", "nonprofit", "educational_institution", "college", "hbcu", "msi"),
    "government": ("government", "public_agency", "local_government", "state_government", "tribal_government", "federal_agency", "municipal"),
    "tribal": ("tribal", "tribal_government", "native_american", "alaska_native", "nonprofit", "government", "tribal_college"),
    "research_institution": ("nonprofit", "university", "research_institution", "higher_education", "academic"),
    "contractor": ("small_business", "for_profit", "8a_certified", "minority_owned", "veteran_owned"),
    "international_ngo": ("nonprofit", "international", "ngo", "international_ngo", "nonprofit_organization"),
    "other": ("all",),
}
#: Which classes an intended applicant suits well, and badly.
SUITS = {
    "community_nonprofit": (("nonprofit", "tribal", "international_ngo"), ("contractor", "government", "small_business")),
    "nonprofit": (("nonprofit", "tribal", "research_institution", "university", "international_ngo"), ()),
    "research_university": (("university", "research_institution"), ("nonprofit", "small_business", "contractor")),
    "hbcu_institution": (("university", "research_institution"), ("nonprofit", "small_business", "contractor", "government")),
    "contractor": (("contractor", "small_business"), ("nonprofit", "university", "research_institution", "international_ngo")),
    "government": (("government", "tribal"), ("nonprofit", "small_business", "contractor", "research_institution")),
    "small_business": (("small_business", "contractor"), ("nonprofit", "university", "government", "research_institution")),
    "healthcare_provider": (("nonprofit", "government", "university"), ()),
    "tribal": (("tribal", "nonprofit", "government"), ()),
    "open": (v2.CLASSES, ()),
}
DIMENSIONS = ("concept_fit", "concept_centrality", "activity_fit", "population_fit", "target_applicant_fit", "eligibility", "geography_fit", "capacity_fit", "funding_fit", "source_relevance")
TIERS = ((70, "excellent"), (55, "strong"), (38, "moderate"))


def population_tags(text: Column, table: dict[int, tuple[str, ...]] = POPULATIONS) -> Column:
    """The populations a normalized text names, without those that are part of a longer one it names."""
    every = tuple(p for level in table.values() for p in level)
    return let(contained(text, every), lambda named: F.filter(named, lambda t: ~F.exists(named, lambda o: (o != t) & o.contains(t))))


def specificity(tags: Column, table: dict[int, tuple[str, ...]] = POPULATIONS) -> Column:
    """The highest specificity among population tags; null if there are none."""
    out = F.lit(None).cast("int")
    for level in sorted(table):
        out = F.when(F.arrays_overlap(tags, strings(table[level])), level).otherwise(out)
    return out


def intended_applicant() -> Column:
    """Whom an opportunity's text addresses, first cue first."""
    text, kind = F.lower(F.concat_ws(" ", "title", "description", F.array_join("eligibility", " "))), F.col("type")
    return (
        F.when(has(text, "hbcu", "historically black college"), "hbcu_institution")
        .when(has(text, "tribal college", "tribal nation", "native american"), "tribal")
        .when((kind == "procurement_contract") | has(text, "vendor", "contractor", "solicitation", "rfp", "rfq"), "contractor")
        .when(has(text, "government agency", "public agency", "local government", "municipal"), "government")
        .when(has(text, "small business", "startup", "entrepreneur", "for-profit"), "small_business")
        .when(has(text, "university", "college", "higher education", "principal investigator") | (kind == "research_grant"), "research_university")
        .when(has(text, "community nonprofit", "community-based", "nonprofit organization", "501(c)(3)", "community organization"), "community_nonprofit")
        .when(has(text, "healthcare provider", "health center", "hospital", "clinic", "federally qualified"), "healthcare_provider")
        .when(has(text, "nonprofit", "ngo", "charity", "foundation"), "nonprofit")
        .otherwise("open")
    )


def opp_features(opps: DataFrame, as_of: Column, concepts: tuple[str, ...] = CONCEPTS, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    title, body = F.col("title_norm"), F.col("body_norm")  # once for all that is made of them
    out = v2.opp_profiles(opps, sectors).withColumns({"title_norm": norm_text(F.col("title")), "body_norm": norm_text(F.col("description"))})
    full = norm_joined(title, body, norm_text(F.array_join("keywords", " ")), norm_text(F.array_join("categories", " ")))
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(parse_date(F.col("open_date")))) / 86400
    return out.select(
        "*",
        intended_applicant().alias("intended"),
        contained(full, concepts).alias("phrases"),
        contained(title, concepts).alias("title_phrases"),
        contained(norm_text(F.substring("description", 1, 350)), concepts).alias("opening_phrases"),
        F.filter(F.split(norm_joined(title, body), " "), lambda t: F.length(t) > 2).alias("words"),
        population_tags(norm_text(F.concat_ws(" ", "title", F.substring("description", 1, 500)))).alias("pops"),
        F.transform("geography", norm_text).alias("places"),
        F.when(days <= 14, 3).when(days <= 30, 2).when(days <= 60, 1).otherwise(0).alias("recency_boost"),
    )


def org_features(orgs: DataFrame, concepts: tuple[str, ...] = CONCEPTS, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    text = norm_text(F.concat_ws(" ", "mission", F.array_join("keywords", " "), F.array_join("program_areas", " ")))
    return v2.org_profiles(orgs, sectors).select(
        "*",
        contained(text, concepts).alias("phrases"),
        F.array_distinct(F.split(text, " ")).alias("words"),
        population_tags(norm_text(F.concat_ws(" ", "mission", F.array_join("population_served", " ")))).alias("pops"),
        F.transform("geography", norm_text).alias("places"),
    )


def sides(opps: DataFrame, orgs: DataFrame, as_of: Column, concepts: tuple[str, ...] = CONCEPTS, sectors: dict[str, list[str]] = SECTORS) -> tuple[DataFrame, DataFrame]:
    """Both sides' features; of an opportunity's words only those that some organization says."""
    own = org_features(orgs, concepts, sectors)
    return opp_features(spread(opps), as_of, concepts, sectors).withColumn("words", only("words", said_by(own, "words"))), own


def pairs(opps: DataFrame, orgs: DataFrame, as_of: Column, concepts: tuple[str, ...] = CONCEPTS, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    return pair_up(*sides(opps, orgs, as_of, concepts, sectors))


def _in(column: str, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether the organization's class is listed under the column's value."""
    out = F.lit(False)
    for key, classes in table.items():
        out = out | ((F.col(column) == key) & F.col("org_class").isin(*classes)) if classes else out
    return out


def refusals() -> dict[str, Column]:
    """The rules by which the gate refuses a class of organization, in the order in which they are told."""
    e, c = F.col("elig"), F.col("org_class")
    any_of = lambda *v: F.arrays_overlap(e, strings(v))
    only = lambda *v: F.forall(e, lambda t: t.isin(*v))
    exempt = any_of("501c3") & ~F.col("org_has_501c3") & ~c.isin("government", "university", "tribal")
    business = only("small_business", "for_profit", "8a_certified", "hubzone", "sdvosb") & ~F.col("org_is_small_business") & ~c.isin("small_business", "contractor")
    nonprofit = any_of("nonprofit", "501c3", "community_based_org", "community_org", "ngo") & ~any_of("for_profit", "small_business", "all") & ~c.isin("nonprofit", "tribal", "research_institution", "university", "international_ngo")
    government = only("government", "public_agency", "state_government", "local_government", "federal_agency") & ~c.isin("government", "tribal")
    return {"501c3_required": exempt, "small_business_only": business, "nonprofit_only": nonprofit, "government_only": government}


def passes() -> Column:
    exempt, business, nonprofit, government = refusals().values()
    return (F.size("elig") == 0) | ~(exempt | business | nonprofit | government)


def eligibility(satisfies: dict[str, tuple[str, ...]] = SATISFIES) -> Column:
    e = F.col("elig")
    any_of = lambda *v: F.arrays_overlap(e, strings(v))
    listed = F.lit(False)
    for c, values in satisfies.items():
        listed = listed | ((F.col("org_class") == c) & any_of(*values))
    best = F.when(F.col("org_has_501c3") & any_of("501c3"), 10).when(F.col("org_is_small_business") & any_of("small_business", "for_profit"), 9).otherwise(8)
    return F.when(F.size(e) == 0, 6).when(any_of("all"), 8).when(listed, best).otherwise(5)


def geography() -> Column:
    """8 for the same place and 6 for a region around it, by the first pair of places that has either; 5 for open, 2 for elsewhere in a national scope, 0 otherwise."""
    text, own, wanted = F.array_join("places", " "), F.col("org_places"), F.col("places")
    names = strings(tuple(REGIONS))
    national = has(text, "united states", "national", "nationwide") | text.isin("us", "usa")
    in_us = F.exists(own, lambda g: g.contains("united states") | g.isin("us", "usa", "national", "nationwide") | F.exists(names, lambda s: g.contains(s) | s.contains(g)))
    alias = F.create_map(*[x for k, v in REGIONS.items() for x in (F.lit(k), strings(v))])
    near = lambda o, p: o.contains(p) | p.contains(o) | F.arrays_overlap(F.coalesce(F.try_element_at(alias, o), F.array(o)), F.coalesce(F.try_element_at(alias, p), F.array(p)))

    def within(a: Column, b: Column) -> Column:
        out = F.lit(False)
        for region, states in REGIONS.items():
            out = out | (a.contains(region) & F.exists(strings(states), lambda s: b.contains(s) | s.contains(b)))
        return out

    related = F.flatten(F.transform(own, lambda o: F.transform(wanted, lambda p: F.when(near(o, p), 8).when(within(o, p) | within(p, o), 6).otherwise(0))))
    first = F.coalesce(F.try_element_at(F.filter(related, lambda v: v > 0), F.lit(1)), F.lit(0))
    return F.when(F.size(wanted) == 0, 5).when(has(text, "global", "international"), 5).when(national, F.when(in_us, 8).otherwise(2)).otherwise(first)


def funding() -> Column:
    """Five zones of the award range against the budget."""
    budget, most, least = F.col("org_annual_budget"), F.coalesce("max_award", "min_award"), F.coalesce("min_award", F.lit(0))
    zones = F.when((most >= budget * 0.10) & (least <= budget * 3.0), 6).when((most >= budget * 0.05) & (least <= budget * 5.0), 4).when(most < budget * 0.05, 2).when(least <= budget * 10.0, 3).otherwise(1)
    return F.when(most.isNull() | (F.coalesce(budget, F.lit(0.0)) <= 0), 3).otherwise(zones)


def applicant_barriers() -> tuple[Column, Column]:
    """Whether procurement, and whether research, is out of the class's usual reach."""
    c, kind = F.col("org_class"), F.col("type")
    return (kind == "procurement_contract") & ~c.isin("contractor", "small_business", "government"), (kind == "research_grant") & ~c.isin("university", "research_institution")


def target_applicant() -> tuple[Column, Column]:
    """Points and mismatch penalty for the intended applicant."""
    c, who = F.col("org_class"), F.col("intended")
    good, bad = _in("intended", {k: v[0] for k, v in SUITS.items()}), _in("intended", {k: v[1] for k, v in SUITS.items()})
    nonprofit, procurement, research = c == "nonprofit", *applicant_barriers()
    fit = F.when((who == "community_nonprofit") & nonprofit, 12).when(who == "open", 8).otherwise(10)
    points = F.when(procurement, 3).when(research, F.when(nonprofit, 5).otherwise(3)).when(good, fit).when(bad, 3).otherwise(6)
    penalty = F.when(procurement, 10).when(research, F.when(nonprofit, 5).otherwise(8)).when(good, 0).when(bad, 8).otherwise(0)
    return points, penalty


def _concept(exact: Column, domains: Column) -> Column:
    concept = F.when(exact >= 3, 18).when(exact == 2, 14).when(exact == 1, 9).when((F.size("org_phrases") > 0) & (F.size("phrases") > 0), 3).otherwise(0)
    return concept + F.when(domains >= 3, 8).when(domains == 2, 5).when(domains == 1, 3).otherwise(0)


def _capacity(second: dict[str, Column]) -> Column:
    return js_round(F.when((F.col("complexity") - F.col("org_capacity")).isNull(), 4).otherwise(second["capacity_fit"]) / 10 * 7)


def _complex() -> Column:
    gap = F.col("complexity") - F.col("org_capacity")
    return js_round(F.when(gap == 1, 3).when(gap == 2, 7).when(gap >= 3, 10).otherwise(0) / 10 * 7)


def _barrier() -> Column:
    out = F.lit(0)
    for source, (_, barred, value) in SOURCES.items():
        out = F.when((F.col("source") == source) & F.col("org_class").isin(*barred), value).otherwise(out) if barred else out
    return out


def _suits() -> Column:
    return F.when(_in("source", {k: v[0] for k, v in SOURCES.items()}), 3).otherwise(1)


def _too_large() -> Column:
    return F.when((F.col("org_annual_budget") > 0) & (F.col("min_award") > F.col("org_annual_budget") * 5), 5).otherwise(0)


def bounded_sides(opps: DataFrame, orgs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with what `bound` needs."""
    mine, own = sides(opps, orgs, as_of)
    fit, mismatch = target_applicant()
    mine, own = with_phrase_bits(mine, own, CONCEPTS)
    return with_class_points(mine.withColumn("pop_level", specificity(F.col("pops"))), passes(), eligibility() + fit - mismatch + _suits() - _barrier()), own


def with_phrase_bits(mine: DataFrame, own: DataFrame, listed: tuple[str, ...], core: str = "phrases") -> tuple[DataFrame, DataFrame]:
    """Adds the phrases and populations that some organization has as bits, of either side, and as core_bits those of the organization's column `core`; bits stay null where there are too many for a number, and then count as all in common."""
    said, named = said_by(own, "phrases"), said_by(own, "pops")
    times = {p: listed.count(p) for p in said or ()}
    none = F.lit(None).cast("long")
    of = lambda c: bits(c, said, times) if said is not None and sum(times.values()) <= 63 else none
    pops = bits("pops", named) if named is not None and len(named) <= 63 else none
    mine = mine.withColumns({"phrase_bits": of("phrases"), "title_bits": of("title_phrases"), "opening_bits": of("opening_phrases"), "pop_bits": pops})
    return mine, own.withColumns({"phrase_bits": of("phrases"), "core_bits": of(core), "pop_bits": pops})


def hits(own: str, column: str) -> Column:
    """How many phrases (or populations) both sides have, or as many as there could be where that isn't known."""
    return F.coalesce(F.bit_count(F.col(own).bitwiseAND(F.col(column))), F.lit(63))


def bound() -> Column:
    """No pair of bounded sides scores more. The words in common, the places and the body's repetitions count as at their best."""
    c, size, second = F.col, F.size, v2.dimension_points()
    exact, shared = hits("org_phrase_bits", "phrase_bits"), hits("org_pop_bits", "pop_bits")
    concept = F.least(F.lit(26), _concept(exact, v2.common("sectors")))
    in_title, in_opening = hits("org_core_bits", "title_bits"), hits("org_core_bits", "opening_bits")
    central = F.when(in_title >= 2, 5).when(in_title == 1, 4).otherwise(2) + F.greatest(F.when(in_opening >= 2, 4).when(in_opening == 1, 2).otherwise(0), F.when(exact > 0, 3).otherwise(0))
    several, both = F.when(shared >= 2, 1).otherwise(0), (size("org_pops") > 0) & (size("pops") > 0)
    named = F.when(c("pop_level") == 4, 7 + several).when(c("pop_level") == 3, 5 + several).when(c("pop_level") == 2, 3 + several).otherwise(2)
    population = F.when(both, F.when(shared > 0, named).otherwise(3)).when(v2.common("populations") > 0, 4).otherwise(2)
    weak = F.when((exact == 0) & (central < 4), F.when(concept < 8, 8).when(concept < 12, 4).otherwise(0)).otherwise(0)
    points = class_points() + concept + F.least(F.lit(10), central) + F.least(F.lit(10), second["activity_fit"]) + population + F.when(size("places") == 0, 5).otherwise(8) + _capacity(second) + funding()
    points = points + js_round(v2.semantic_boost() / 10 * 8) + c("recency_boost") - weak - _complex() - _too_large()
    return points


def score_v4(pairs: DataFrame) -> DataFrame:
    """Adds ten dimensions, boosts, penalties by type, penalty_total, total, confidence and passes_eligibility; failing pairs score 0 and are `ineligible`."""
    c, size = F.col, F.size
    out = pairs.withColumns({
        "exact": F.filter("org_phrases", lambda p: F.array_contains("phrases", p)),
        "domains": v2.common("sectors"),
        "matched": F.filter("words", lambda t: F.array_contains("org_words", t)),
        "shared_pops": F.array_intersect("pops", "org_pops"),
        "title_hits": size(F.filter("org_phrases", lambda p: F.array_contains("title_phrases", p))),
        "opening_hits": size(F.filter("org_phrases", lambda p: F.array_contains("opening_phrases", p))),
    })
    special = F.filter("matched", lambda t: ~t.isin(*GENERIC) & (F.length(t) > 3))
    out = out.withColumn("specific", F.when(size("matched") > 0, size(special) / size("matched")).otherwise(0.0))
    exact, domains, ratio = size("exact"), c("domains"), c("specific")
    concept = _concept(exact, domains)
    concept = F.least(F.lit(26), F.when((exact == 0) & (ratio < 0.3) & (concept > 3), concept - 3).otherwise(concept))
    title = F.when(c("title_hits") >= 2, 5).when(c("title_hits") == 1, 4).when(F.exists("org_sectors", lambda t: c("title_norm").contains(t)), 2).otherwise(0)
    first = F.try_element_at("org_phrases", F.lit(1))
    times = F.coalesce((F.length("body_norm") - F.length(F.replace(c("body_norm"), first, F.lit("")))) / F.length(first), F.lit(0.0))
    repeated = F.greatest(F.when(c("opening_hits") >= 2, 4).when(c("opening_hits") == 1, 2).otherwise(0), F.when(times >= 3, 3).otherwise(0))
    own, theirs, shared = c("org_pops"), c("pops"), size("shared_pops")
    level = specificity(c("shared_pops"))
    partly = F.exists(own, lambda a: F.exists(theirs, lambda b: a.contains(b) | b.contains(a)))
    several = F.when(shared >= 2, 1).otherwise(0)
    both = (size(own) > 0) & (size(theirs) > 0)
    population = F.when(
        both, F.when(shared > 0, F.when(level == 4, 7 + several).when(level == 3, 5 + several).when(level == 2, 3 + several).otherwise(2)).when(partly, 3).otherwise(1)
    ).otherwise(F.when(v2.common("populations") > 0, 4).otherwise(2))
    target, mismatch = target_applicant()
    second = v2.dimension_points()
    points = {
        "concept_fit": concept, "concept_centrality": F.least(F.lit(10), title + repeated), "activity_fit": F.least(F.lit(10), second["activity_fit"]), "population_fit": population, "target_applicant_fit": target, "eligibility": eligibility(),
        "geography_fit": geography(), "capacity_fit": _capacity(second), "funding_fit": funding(), "source_relevance": _suits(),
    }
    out = out.withColumn("passes_eligibility", passes()).withColumn("mismatch", mismatch)
    ok = c("passes_eligibility")
    out = out.withColumns({k: F.when(ok, v).otherwise(0).cast("long") for k, v in points.items()})
    out = out.withColumn("base_score", sum((c(d) for d in DIMENSIONS[1:]), c(DIMENSIONS[0]))).withColumn("semantic_boost", F.when(ok, js_round(v2.semantic_boost() / 10 * 8)).otherwise(0).cast("long")).withColumn("recency_boost", F.when(ok, c("recency_boost")).otherwise(0).cast("long"))

    base, none = c("base_score"), exact == 0
    generic = F.when(none & (ratio < 0.2) & (base > 30), F.least(F.lit(15), js_round(base * (1 - ratio) * 0.35))).when(none & (ratio < 0.35), F.least(F.lit(8), js_round(base * (1 - ratio) * 0.15))).otherwise(0)
    weak = F.when(none & (c("concept_centrality") < 4), F.when(c("concept_fit") < 8, 8).when(c("concept_fit") < 12, 4).otherwise(0)).otherwise(0)
    pointed = lambda tags: F.arrays_overlap(tags, strings(POPULATIONS[3] + POPULATIONS[4]))
    apart = F.when((shared == 0) & both & pointed(theirs), F.when(pointed(own), 6).otherwise(3)).otherwise(0)
    rules = {"genericity": generic, "weak_specificity": weak, "target_applicant_mismatch": c("mismatch"), "population_mismatch": apart, "complexity_mismatch": _complex(), "source_barrier": _barrier(), "funding_capacity_mismatch": _too_large()}
    applied = F.array(*[F.struct(F.lit(k).alias("type"), F.when(ok, v).otherwise(0).cast("long").alias("value")) for k, v in rules.items()])
    out = out.withColumn("penalties", F.filter(applied, lambda p: p["value"] > 0)).withColumn("penalty_total", F.aggregate("penalties", F.lit(0).cast("long"), lambda s, p: s + p["value"]))
    out = out.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), base + c("semantic_boost") + c("recency_boost") - c("penalty_total"))))
    tier = F.lit("weak")
    for least, name in reversed(TIERS):
        tier = F.when(c("total") >= least, name).otherwise(tier)
    return out.withColumn("confidence", F.when(ok, tier).otherwise("ineligible")).drop("exact", "domains", "matched", "shared_pops", "title_hits", "opening_hits", "mismatch")
