"""Why a pair scored as it did: `reasons` and `risks` of the profile, hybrid, specificity-first and source-aware scorers.

Each function takes a scorer's rows with both sides' columns and adds two lists of sentences, in the order in which they are told. They are meant for ranked rows: a sentence needs the
words in common as such, which scoring only counts. A pair that the gate refuses has no reasons and one risk, the rule that refused it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round, strings
from . import scoring_v2 as v2
from . import scoring_v3 as v3
from . import scoring_v4 as v4

#: The sentences that results contain, by penalty or by rule.
V2_PENALTIES = {
    "procurement_mismatch": "Procurement opportunity requires contracting infrastructure the org may lack",
    "research_mismatch": "Research grant typically requires scientific capacity not evident in this org profile",
    "geography_scope_mismatch": "Local/state-limited opportunity may not accept international organizations",
    "eu_procurement_barrier": "EU procurement may require business registration or local EU partner",
}
V3_PENALTIES = {
    "procurement_barrier": "Procurement requires SAM registration and past performance",
    "eu_barrier": "EU procurement may require EU business registration or local partner",
}
SOURCE_BARRIERS = {
    "sbir": "SBIR/STTR is exclusively for small businesses — nonprofits and universities are not eligible",
    "sam_gov": "SAM.gov primarily lists federal procurement contracts requiring SAM registration and past performance",
    "ted_eu": "EU procurement requires EU business registration or local EU partner",
    "world_bank": "World Bank procurement typically requires international operations capability",
    "threesixtygiving": "360Giving / UKRI awards philanthropic grants primarily to nonprofits and academic institutions",
}
REFUSALS = {
    "501c3_required": "501(c)(3) required — org does not have it",
    "small_business_only": "Small-business-only opportunity; org is not a small business",
    "government_only": "Government-only opportunity; org is not a government entity",
}
RESEARCH = "Research grants typically require PI credentials, IRB, and academic infrastructure"
EARLY = "Early-stage org applying for a complex opportunity — build a strong narrative"


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _first(names: Column, n: int) -> Column:
    return F.array_join(F.slice(names, 1, n), ", ")


def _plain(column: str) -> Column:
    return F.replace(F.col(column), F.lit("_"), F.lit(" "))


def _amount(column: str) -> Column:
    return F.call_function("format_number", F.col(column), F.lit("#,##0.###"))


def _known(column: str) -> Column:
    """The organization's list of `column`, as far as the opportunity has it too."""
    return F.filter(f"org_{column}", lambda t: F.array_contains(column, t))


def _told(scored: DataFrame, reasons: list[Column], risks: Column, refusal: Column) -> DataFrame:
    ok = F.col("passes_eligibility")
    return scored.withColumn("reasons", F.when(ok, F.array_compact(F.array(*reasons))).otherwise(strings(()))).withColumn("risks", F.when(ok, risks).otherwise(F.array(refusal)))


def _by_type(sentences: dict[str, Column]) -> Column:
    """The sentences of the penalties that apply."""

    def one(p: Column) -> Column:
        out = p["type"]
        for kind, text in sentences.items():
            out = F.when(p["type"] == kind, text).otherwise(out)
        return out

    return F.transform("penalties", one)


def _bands() -> tuple[Column, Column]:
    return F.get(strings(v2.BANDS), F.col("org_capacity")), F.get(strings(v2.COMPLEXITY), F.col("complexity"))


def _v2_refusal() -> Column:
    sentences = {"nonprofit_only": _say('Nonprofit-only opportunity; org class is "', F.col("org_class"), '"'), "small_business_only": F.lit(REFUSALS["small_business_only"]), "501c3_required": F.lit("501(c)(3) required but org does not have it")}
    return F.coalesce(*[F.when(when, sentences[rule]) for rule, when in v2.refusals().items()])


def _v2_penalties() -> Column:
    own, wanted = _bands()
    return _by_type({
        "complexity_mismatch": _say("Org capacity (", own, ") is below opportunity complexity (", wanted, ")"),
        "funding_capacity_mismatch": _say("Minimum award ($", _amount("min_award"), ") may exceed org management capacity (budget: $", _amount("org_budget"), ")"),
    } | {k: F.lit(text) for k, text in V2_PENALTIES.items()})


def _cautions(procurement: str) -> list[Column]:
    """An early organization before a complex opportunity, and one outside procurement before a contract."""
    return [F.when((F.col("org_capacity") == 0) & (F.col("complexity") >= 2), EARLY), F.when(v4.applicant_barriers()[0], procurement)]


def _fit(natural: int, competitive: int, column: str) -> Column:
    points, c = F.col(column), F.col("org_class")
    return F.when(points >= natural, _say(c, " is a natural fit for ", _plain("type"))).when(points >= competitive, _say(c, " can competitively apply to ", _plain("type")))


def reasons_v2(scored: DataFrame) -> DataFrame:
    """Adds `reasons` and `risks` to the profile scorer's rows."""
    c = F.col
    reasons = [
        F.when(c("eligibility_fit") >= 17, _say('Strong eligibility — "', c("org_class"), '" is a primary applicant type')).when(c("eligibility_fit") >= 12, "Meets eligibility requirements for this opportunity"),
        F.when(c("domain_fit") >= 15, _say("Strong domain alignment: ", _first(_known("sectors"), 3))).when(c("domain_fit") >= 8, "Moderate domain overlap with opportunity focus areas"),
        _fit(9, 7, "organization_type_fit"),
        F.when(c("geography_fit") >= 9, "Geography aligns with opportunity scope"),
        F.when(c("funding_fit") >= 4, "Award size is realistic for this organization's budget"),
        F.when(c("semantic_boost") >= 5, "Multiple strong alignment signals detected across domains, activities, and populations"),
    ]
    early = F.array(
        F.when(c("domain_fit") == 0, "No domain tag overlap detected — verify mission relevance"),
        F.when(c("geography_fit") <= 2, "Geographic scope may not match — verify eligibility before applying"),
    )
    late = F.array(*_cautions("Procurement opportunities typically require registered SAM/DUNS and past performance documentation"))
    return _told(scored, reasons, F.array_compact(F.concat(early, _v2_penalties(), late)), _v2_refusal())


def reasons_hybrid(scored: DataFrame) -> DataFrame:
    """Adds `reasons` and `risks` to the hybrid scorer's rows; a refused pair tells the profile scorer's rule."""
    c = F.col
    years = F.when(c("org_years_in_operation") >= 0, c("org_years_in_operation"))
    mission = c("mission_domain")
    reasons = [
        F.when(mission >= 18, _say("Strong mission–opportunity alignment (", mission.cast("string"), "/25)")).when(mission >= 10, _say("Moderate domain overlap (", mission.cast("string"), "/25)")),
        F.when(c("eligibility") >= 17, _say('Confirmed eligibility for "', c("org_class"), '" org class')).when(c("eligibility") >= 12, "Passes eligibility requirements"),
        _fit(10, 7, "org_type_fit"),
        F.when(c("geography_fit") >= 9, "Geography aligns with opportunity scope"),
        F.when(c("capacity_fit") >= 8, "Organizational capacity matches opportunity complexity"),
        F.when(c("funding_fit") >= 6, "Award size is realistic for this organization's budget"),
        F.when(c("semantic_boost") >= 6, "Multiple strong alignment signals across domains, activities, and populations"),
        F.when(c("maturity_boost") >= 3, _say("Track record of ", F.coalesce(F.call_function("format_number", years, F.lit("0.###")), F.lit("null")), " years supports credibility")),
    ]
    early = F.array(
        F.when(mission <= 4, "Weak keyword and taxonomy overlap — verify mission relevance"),
        F.when(c("org_type_fit") <= 3, "Org type may not be the primary applicant class for this opportunity"),
        F.when(c("geography_fit") <= 2, "Geographic scope may not match — verify before applying"),
        F.when(c("capacity_fit") <= 3, "Opportunity complexity may exceed current capacity — address in narrative"),
        F.when(c("funding_fit") <= 2, "Funding size may be misaligned with organizational budget"),
        F.when((c("maturity_boost") < 3) & (years < 2), "Early-stage organization — strengthen narrative to compensate"),
    )
    late = F.array(*_cautions("Procurement opportunities typically require SAM/DUNS registration and past performance documentation"))
    return _told(scored.withColumn("penalties", v2.penalties()), reasons, F.array_compact(F.concat(early, _v2_penalties(), late)), _v2_refusal()).drop("penalties")


def _strict_refusal(excluded: Column | None = None) -> Column:
    sentences = {k: F.lit(text) for k, text in REFUSALS.items()} | {"nonprofit_only": _say('Nonprofit-only; org class is "', F.col("org_class"), '"')}
    rules = [F.when(when, sentences[rule]) for rule, when in v4.refusals().items()]
    if excluded is not None:
        rules.append(F.when(excluded, _say('Org class "', F.col("org_class"), '" is explicitly excluded by applicant type constraints')))
    return F.coalesce(*rules)


def _mismatch(procurement: str) -> Column:
    """Why the intended applicant is another; null where it isn't."""
    barred, research = v4.applicant_barriers()
    designed = _say('Opportunity designed for "', _plain("intended"), '" — org type may not be competitive')
    return F.when(barred, procurement).when(research, RESEARCH).when(v4.target_applicant()[1] > 0, designed)


def _pointed(column: str, table: dict[int, tuple[str, ...]]) -> Column:
    """The first population of a list that is one of the specific ones."""
    return F.get(F.filter(column, lambda p: F.array_contains(strings(table[3] + table[4]), p)), F.lit(0))


def _exact(exact: Column, several: str) -> Column:
    n = F.size(exact)
    return F.when(n >= 2, _say(n.cast("string"), several, _first(exact, 2))).when(n == 1, _say('Exact concept match: "', F.get(exact, F.lit(0)), '"'))


def _penalized(which: str, value: int) -> Column:
    return F.exists("penalties", lambda p: (p["type"] == which) & (p["value"] == value))


def _vague(text: str, otherwise: str) -> Column:
    strong = (F.col("specific") < 0.2) & (F.col("base_score") > 30)
    return F.when(strong, _say(text, js_round(F.col("specific") * 100).cast("string"), "%)")).otherwise(otherwise)


def _shared_sentences() -> dict[str, Column]:
    own, wanted = _bands()
    return {
        "complexity_mismatch": _say("Org capacity (", own, ") below opportunity complexity (", wanted, ")"),
        "funding_capacity_mismatch": _say("Min award ($", _amount("min_award"), ") may exceed org management capacity"),
    }


def reasons_v3(scored: DataFrame) -> DataFrame:
    """Adds `reasons` and `risks` to the specificity-first scorer's rows."""
    c, exact, shared = F.col, _known("phrases"), F.array_intersect("pops", "org_pops")
    n = F.size(shared)
    reasons = [
        _exact(exact, " exact concept phrases match: "),
        F.when(c("concept_centrality") >= 6, "Core concept featured in opportunity title"),
        F.when(c("target_applicant_fit") >= 10, _say('"', c("org_class"), '" is the intended applicant type')),
        F.when(c("population_fit") >= 6, _say("Population match", F.when(n > 1, "es").otherwise(""), ": ", _first(shared, 3), " (specificity ", v4.specificity(shared, v3.POPULATIONS).cast("string"), "/4)")),
        F.when(c("eligibility") >= 9, "Strong eligibility confirmation"),
        F.when(c("semantic_boost") >= 5, "Multi-signal alignment boost"),
    ]
    mismatch = _mismatch("Procurement opportunities require SAM/DUNS registration, past-performance documentation, and contractor experience")
    theirs = _pointed("pops", v3.POPULATIONS)
    apart = F.when(_penalized("population_mismatch", 6), _say("Population mismatch: org serves ", _pointed("org_pops", v3.POPULATIONS), ", opp targets ", theirs)).otherwise(_say("Opp targets specific population (", theirs, ") not explicitly served by org"))
    weak = F.when(_penalized("weak_specificity", 8), "Weak concept fit and low centrality — opportunity not centrally relevant to org mission").otherwise("No central concept connection found")
    sentences = {
        "genericity": _vague("Score driven by generic terms (specificity ratio ", "Mostly generic overlap — weak specificity signal"), "weak_specificity": weak, "target_applicant_mismatch": mismatch, "population_mismatch": apart,
    } | _shared_sentences() | {k: F.lit(text) for k, text in V3_PENALTIES.items()}
    first = F.array(
        F.when((F.size(exact) == 0) & (c("specific") < 0.3), "Score driven by generic terms — verify mission relevance before applying"),
        F.when((c("concept_centrality") == 0) & (c("concept_fit") < 12), "Core concepts are not centrally featured in opportunity — may be a peripheral match"),
        F.when(v4.target_applicant()[1] > 5, mismatch),
        F.when(_penalized("population_mismatch", 6) | _penalized("population_mismatch", 3), apart),
    )
    return _told(scored, reasons, F.array_distinct(F.array_compact(F.concat(first, _by_type(sentences)))), _strict_refusal(v3.excluded()))


def reasons_v4(scored: DataFrame) -> DataFrame:
    """Adds `reasons` and `risks` to the source-aware scorer's rows."""
    c, exact, shared = F.col, _known("phrases"), F.array_intersect("pops", "org_pops")
    reasons = [
        _exact(exact, " exact concept phrases: "),
        F.when(c("concept_centrality") >= 5, "Core concept featured in opportunity title"),
        F.when(c("target_applicant_fit") >= 10, _say('"', c("org_class"), '" is the intended applicant type')),
        F.when(F.size(shared) > 0, _say("Population match: ", _first(shared, 2))),
        F.when(c("eligibility") >= 9, "Strong eligibility confirmation"),
        F.when(c("geography_fit") >= 7, "Geographic alignment confirmed"),
        F.when(c("semantic_boost") >= 5, "Multi-signal alignment boost"),
        F.when(c("recency_boost") > 0, "Recently posted opportunity"),
    ]
    mismatch = _mismatch("Procurement requires SAM registration, past-performance documentation, and contractor experience")
    barrier = F.col("source")
    for source, text in SOURCE_BARRIERS.items():
        barrier = F.when(F.col("source") == source, text).otherwise(barrier)
    sentences = {
        "genericity": _vague("Score driven by generic terms (specificity ", "Mostly generic overlap"),
        "weak_specificity": F.when(_penalized("weak_specificity", 8), "Weak concept fit and low centrality").otherwise("No central concept connection found"),
        "target_applicant_mismatch": mismatch,
        "population_mismatch": _say("Pop mismatch: org serves ", F.get("org_pops", F.lit(0)), ", opp targets ", _pointed("pops", v4.POPULATIONS)),
        "source_barrier": barrier,
    } | _shared_sentences()
    first = F.array(F.when((F.size(exact) == 0) & (c("specific") < 0.3), "Score driven by generic terms — verify mission relevance"), F.when(v4.target_applicant()[1] > 5, mismatch))
    return _told(scored, reasons, F.array_distinct(F.array_compact(F.concat(first, _by_type(sentences)))), _strict_refusal())
