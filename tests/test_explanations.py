"""Sentences of the four scorers for rows worked out by hand."""

from pyspark.sql import functions as F

from quillrank.operators import explanations

SIDES = {
    "org_class": "'nonprofit'", "org_has_501c3": "false", "org_is_small_business": "false", "org_capacity": "0", "org_budget": "1234567.5D", "org_years_in_operation": "1D", "org_sectors": "array('health', 'housing', 'youth')", "sectors": "array('youth', 'health')",
    "org_phrases": "array('food bank', 'job training', 'clean energy')", "phrases": "array('job training', 'clean energy', 'food bank')", "org_pops": "array('youth', 'pregnant people')", "pops": "array('veterans with ptsd')",
    "elig": "array('nonprofit')", "type": "'procurement_contract'", "intended": "'contractor'", "complexity": "3", "min_award": "9876543L", "source": "'ted_eu'", "scope": "'national'", "org_scope": "'local'", "org_procurement_readiness": "'low'", "org_research_readiness": "'low'",
}


def told(spark, reasons, penalties=(), ok=True, **values):
    columns = SIDES | {"passes_eligibility": str(ok).lower()} | {k: v if isinstance(v, str) else f"{v}L" if isinstance(v, int) else f"{v}D" for k, v in values.items()}
    row = spark.range(1).selectExpr(*[f"{v} as {k}" for k, v in columns.items()])
    applied = [F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in penalties]
    row = row.withColumn("penalties", F.array(*applied) if applied else F.expr("cast(array() as array<struct<type:string,value:int>>)"))
    got = reasons(row).select("reasons", "risks").first()
    return list(got["reasons"]), list(got["risks"])


def test_profile_scorer(spark):
    points = {"eligibility_fit": 17, "domain_fit": 15, "organization_type_fit": 3, "geography_fit": 2, "funding_fit": 4, "semantic_boost": 5}
    reasons, risks = told(spark, explanations.reasons_v2, (("complexity_mismatch", 10), ("funding_capacity_mismatch", 5)), **points)
    assert reasons == [
        'Strong eligibility — "nonprofit" is a primary applicant type',
        "Strong domain alignment: health, youth",
        "Award size is realistic for this organization's budget",
        "Multiple strong alignment signals detected across domains, activities, and populations",
    ]
    assert risks == [
        "Geographic scope may not match — verify eligibility before applying",
        "Org capacity (early) is below opportunity complexity (very_high)",
        "Minimum award ($9,876,543) may exceed org management capacity (budget: $1,234,567.5)",
        "Early-stage org applying for a complex opportunity — build a strong narrative",
        "Procurement opportunities typically require registered SAM/DUNS and past performance documentation",
    ]


def test_profile_scorer_tells_the_rule_that_refused(spark):
    points = {k: 0 for k in ("eligibility_fit", "domain_fit", "organization_type_fit", "geography_fit", "funding_fit", "semantic_boost")}
    assert told(spark, explanations.reasons_v2, ok=False, elig="array('501c3', 'small_business')", **points) == ([], ["501(c)(3) required but org does not have it"])
    assert told(spark, explanations.reasons_v2, ok=False, elig="array('small_business')", **points) == ([], ["Small-business-only opportunity; org is not a small business"])
    assert told(spark, explanations.reasons_v2, ok=False, elig="array('501c3')", org_class="'contractor'", **points) == ([], ['Nonprofit-only opportunity; org class is "contractor"'])


def test_hybrid_scorer(spark):
    points = {"mission_domain": 11, "eligibility": 12, "org_type_fit": 7, "geography_fit": 9, "capacity_fit": 3, "funding_fit": 2, "semantic_boost": 0, "maturity_boost": 1}
    reasons, risks = told(spark, explanations.reasons_hybrid, org_procurement_readiness="'high'", type="'planning_grant'", source="'sbir'", complexity=0, min_award="cast(null as long)", **points)
    assert reasons == ["Moderate domain overlap (11/25)", "Passes eligibility requirements", "nonprofit can competitively apply to planning grant", "Geography aligns with opportunity scope"]
    assert risks == ["Opportunity complexity may exceed current capacity — address in narrative", "Funding size may be misaligned with organizational budget", "Early-stage organization — strengthen narrative to compensate"]
    reasons, risks = told(spark, explanations.reasons_hybrid, org_years_in_operation="7.5D", **points | {"mission_domain": 4, "maturity_boost": 4, "capacity_fit": 8})
    assert reasons[-2:] == ["Organizational capacity matches opportunity complexity", "Track record of 7.5 years supports credibility"] and risks[0] == "Weak keyword and taxonomy overlap — verify mission relevance"
    assert risks[-3:] == ["EU procurement may require business registration or local EU partner", "Early-stage org applying for a complex opportunity — build a strong narrative", "Procurement opportunities typically require SAM/DUNS registration and past performance documentation"]


POINTS = {"concept_fit": 3, "concept_centrality": 0, "target_applicant_fit": 3, "population_fit": 1, "eligibility": 8, "geography_fit": 0, "semantic_boost": 4, "recency_boost": 0, "specific": 0.125, "base_score": 31}


def test_specificity_first_scorer(spark):
    applied = (("genericity", 9), ("weak_specificity", 8), ("target_applicant_mismatch", 10), ("population_mismatch", 6), ("procurement_barrier", 8))
    reasons, risks = told(spark, explanations.reasons_v3, applied, phrases="array('water')", pops="array('veterans', 'rural communities')", org_pops="array('everyone', 'youth')", **POINTS)
    assert reasons == []
    assert risks[0] == "Score driven by generic terms — verify mission relevance before applying"
    assert risks[1] == "Core concepts are not centrally featured in opportunity — may be a peripheral match"
    assert risks[2] == "Procurement opportunities require SAM/DUNS registration, past-performance documentation, and contractor experience"
    assert "Score driven by generic terms (specificity ratio 13%)" in risks and "Weak concept fit and low centrality — opportunity not centrally relevant to org mission" in risks
    assert risks[-1] == "Procurement requires SAM registration and past performance" and len(risks) == len(set(risks))
    one = POINTS | {"concept_centrality": 6, "eligibility": 9, "semantic_boost": 5, "target_applicant_fit": 10}
    reasons, risks = told(spark, explanations.reasons_v3, type="'other'", intended="'nonprofit'", phrases="array('food bank')", **one)
    assert reasons == ['Exact concept match: "food bank"', "Core concept featured in opportunity title", '"nonprofit" is the intended applicant type', "Strong eligibility confirmation", "Multi-signal alignment boost"] and risks == []
    refused = told(spark, explanations.reasons_v3, ok=False, elig="array('small_business', 'all')", **POINTS)
    assert refused == ([], ['Org class "nonprofit" is explicitly excluded by applicant type constraints'])


def test_source_aware_scorer(spark):
    applied = (("genericity", 3), ("target_applicant_mismatch", 8), ("source_barrier", 10), ("funding_capacity_mismatch", 5))
    reasons, risks = told(spark, explanations.reasons_v4, applied, type="'other'", intended="'research_university'", **POINTS | {"base_score": 20, "geography_fit": 7, "recency_boost": 2})
    assert reasons == ["3 exact concept phrases: food bank, job training", "Geographic alignment confirmed", "Recently posted opportunity"]
    assert risks == [
        'Opportunity designed for "research university" — org type may not be competitive',
        "Mostly generic overlap",
        "EU procurement requires EU business registration or local EU partner",
        "Min award ($9,876,543) may exceed org management capacity",
    ]
    assert told(spark, explanations.reasons_v4, ok=False, elig="array('government')", **POINTS) == ([], ["Government-only opportunity; org is not a government entity"])
