"""Domains and populations that a text speaks of, and the phrases and words that say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.phrases import contained, found
from ..functions.text import let, strings, table
from .scoring_v5 import GENERIC, MISSION_PHRASES

#: Domain, subdomain, weight, phrases, and single words that count where no phrase is found.
DOMAINS = (
    ("health", "maternal_health", 20, ("maternal health equity", "maternal health", "birth equity", "maternal mortality", "prenatal care", "prenatal health", "postpartum", "birth outcomes", "obstetric", "maternal care", "pregnancy outcomes", "prenatal and postnatal", "black maternal", "reproductive health"),
     ("maternal", "prenatal", "postpartum", "obstetric", "perinatal")),
    ("health", "mental_health", 20, ("mental health equity", "mental health", "behavioral health", "substance use disorder", "substance use", "substance abuse", "addiction treatment", "suicide prevention", "crisis intervention", "mental wellness", "opioid", "psychiatric services", "peer support services", "recovery services"),
     ("mental", "behavioral", "psychiatric", "counseling", "addiction", "opioid", "overdose")),
    ("health", "health_equity", 18, ("health equity", "health disparities", "health inequity", "health access", "health outcomes equity", "social determinants of health", "sdoh"), ("disparities", "inequity")),
    ("health", "public_health", 14, ("public health", "community health", "population health", "preventive care", "health promotion", "disease prevention", "epidemiology", "infectious disease", "immunization", "vaccination"), ("epidemiology", "immunization", "vaccination", "pandemic")),
    ("health", "chronic_disease", 16, ("chronic disease", "diabetes prevention", "cardiovascular health", "cancer screening", "obesity prevention", "diabetes management"), ("diabetes", "cardiovascular", "cancer", "hypertension", "obesity", "chronic")),
    ("health", "sexual_health", 16, ("sexual health", "hiv prevention", "hiv/aids", "hiv aids", "sexually transmitted infections", "reproductive health"), ("hiv", "aids")),
    ("workforce", "workforce_development", 20, ("workforce development", "workforce readiness", "workforce training", "workforce program", "workforce initiative", "job training", "career development", "vocational training", "employment services", "skills training", "career readiness", "job skills", "career pathways",
     "career preparation", "employment training", "occupational training", "workforce innovation", "wioa"), ("workforce", "vocational", "apprenticeship", "upskilling", "reskilling")),
    ("workforce", "youth_workforce", 20, ("youth workforce", "youth employment", "youth career", "young adult employment", "youth job training", "youth work experience", "youth apprenticeship", "youth internship", "opportunity youth", "disconnected youth"), ()),
    ("education", "early_childhood", 20, ("early childhood education", "early childhood development", "preschool education", "early learning", "head start", "early head start", "child care", "childcare", "early care", "infant toddler"), ("preschool", "kindergarten", "toddler", "daycare", "pre-k")),
    ("education", "k12", 16, ("k-12 education", "k12 education", "elementary education", "secondary education", "school-based", "after-school", "afterschool", "summer learning", "dropout prevention", "alternative education", "out-of-school"), ("elementary", "middle school", "high school", "dropout", "truancy")),
    ("education", "stem", 18, ("stem education", "stem learning", "stem program", "science education", "technology education", "math education", "computer science education", "coding education", "science technology engineering", "stem pipeline"), ("stem", "coding")),
    ("education", "higher_education", 14, ("higher education", "college access", "college readiness", "college persistence", "postsecondary education", "community college", "college completion"), ("postsecondary", "hbcu", "msi")),
    ("education", "literacy", 16, ("adult literacy", "reading literacy", "digital literacy", "financial literacy", "health literacy", "basic literacy", "adult education"), ("literacy", "numeracy")),
    ("education", "arts_education", 16, ("arts education", "arts in education", "arts integration", "music education", "creative arts education", "arts and education"), ()),
    ("housing", "affordable_housing", 20, ("affordable housing", "housing affordability", "affordable homes", "affordable rental", "low income housing", "subsidized housing", "workforce housing", "affordable homeownership"), ()),
    ("housing", "homelessness", 20, ("homelessness prevention", "homeless services", "emergency shelter", "transitional housing", "permanent supportive housing", "housing first", "rapid rehousing", "housing insecurity", "housing instability", "people experiencing homelessness", "unhoused", "shelter services", "street outreach"),
     ("homeless", "unhoused", "shelter")),
    ("housing", "housing_assistance", 16, ("housing assistance", "rental assistance", "mortgage assistance", "down payment assistance", "housing voucher", "housing subsidy", "section 8", "housing choice voucher"), ()),
    ("community_development", "neighborhood", 14, ("neighborhood revitalization", "community revitalization", "neighborhood development", "place-based development", "community investment", "community resilience", "distressed communities", "disinvested communities"), ("revitalization", "disinvested")),
    ("community_development", "block_grant", 16, ("community development block grant", "cdbg", "community services block grant", "csbg", "community action", "community action agency", "community benefit", "community action plan"), ("cdbg", "csbg")),
    ("community_development", "economic_development", 14, ("economic development", "economic opportunity", "economic mobility", "economic empowerment", "wealth building", "asset building", "financial inclusion", "financial capability", "financial coaching", "poverty reduction", "anti-poverty"), ("poverty", "financial")),
    ("climate", "clean_energy", 20, ("clean energy", "renewable energy", "solar energy", "wind energy", "energy efficiency", "clean power", "solar power", "wind power", "geothermal energy", "energy storage", "battery storage", "clean electricity", "zero emission", "electric vehicle"),
     ("solar", "wind", "renewable", "geothermal", "photovoltaic")),
    ("climate", "decarbonization", 20, ("carbon reduction", "greenhouse gas", "carbon emissions", "decarbonization", "net zero", "climate change", "climate action", "climate resilience", "climate adaptation", "carbon neutrality", "carbon capture", "emissions reduction", "net-zero"),
     ("carbon", "decarbonization", "emissions", "greenhouse", "net-zero")),
    ("climate", "environmental_justice", 18, ("environmental justice", "environmental equity", "climate justice", "environmental health", "environmental protection", "brownfields", "clean water", "water quality", "air quality", "clean air", "pollution reduction"), ("brownfield", "superfund", "pollution", "contamination")),
    ("climate", "sustainable_agriculture", 16, ("sustainable agriculture", "agricultural technology", "agritech", "precision agriculture", "regenerative agriculture", "soil health", "food systems", "conservation agriculture", "sustainable farming"), ("agritech", "agtech", "agroforestry")),
    ("food", "food_security", 20, ("food security", "food access", "food insecurity", "food assistance", "nutrition assistance", "food bank", "food pantry", "emergency food", "nutrition services", "food desert", "food justice", "snap outreach", "wic services"), ("hunger", "snap", "wic", "pantry")),
    ("public_safety", "violence_prevention", 20, ("violence prevention", "community violence intervention", "gun violence prevention", "gun violence", "domestic violence", "intimate partner violence", "sexual assault", "violence reduction", "anti-violence", "trauma-informed", "community safety"), ("violence", "victimization")),
    ("public_safety", "justice", 18, ("criminal justice reform", "justice reform", "reentry", "reentry services", "formerly incarcerated", "incarceration reduction", "recidivism", "legal aid", "access to justice", "public defender", "restorative justice", "diversion program"), ("reentry", "recidivism", "parole", "probation")),
    ("small_business", "sbir_sttr", 20, ("sbir", "sttr", "sbir phase i", "sbir phase ii", "small business innovation research", "small business technology transfer"), ("sbir", "sttr")),
    ("small_business", "entrepreneurship", 18, ("small business development", "small business support", "entrepreneurship", "business incubator", "business accelerator", "commercialization", "technology transfer", "startup ecosystem", "business formation", "entrepreneur support", "minority business", "women-owned business", "microloan"),
     ("startup", "entrepreneur", "incubator", "accelerator", "commercialization")),
    ("technology", "digital_equity", 18, ("digital equity", "digital inclusion", "broadband access", "internet access", "digital divide", "technology access", "connectivity", "digital skills", "tech access"), ("broadband", "connectivity")),
    ("technology", "innovation", 14, ("technology innovation", "research and development", "r&d", "technology commercialization", "innovation hub", "advanced manufacturing", "emerging technology"), ()),
    ("veterans", "veteran_services", 20, ("veteran services", "veteran housing", "veteran mental health", "veteran employment", "veteran care", "veteran support", "military veterans", "service members", "military families", "veteran outreach", "va services"), ("veteran", "veterans", "military")),
    ("disability", "disability_services", 18, ("disability services", "people with disabilities", "accessibility", "assistive technology", "independent living", "disability inclusion", "supported employment", "vocational rehabilitation"), ("disability", "disabled", "accessibility", "adaptive")),
    ("arts_culture", "arts", 16, ("arts and culture", "creative arts", "performing arts", "visual arts", "public art", "cultural arts", "arts programming", "arts organization", "community arts", "arts access", "arts in health"), ("arts", "culture", "creative", "theater", "museum", "gallery", "dance", "music")),
    ("research", "applied_research", 14, ("research and development", "applied research", "basic research", "demonstration project", "clinical trial", "scientific research", "academic research", "research grant", "investigator-initiated"), ("research", "trial", "investigation", "demonstration")),
    ("international", "global_development", 14, ("international development", "global health", "foreign assistance", "developing countries", "global poverty", "overseas development", "humanitarian assistance", "global education"), ("international", "overseas", "foreign", "developing")),
    ("transportation", "transit", 14, ("public transportation", "mass transit", "transit services", "transportation access", "mobility services", "public transit", "transportation infrastructure"), ("transit", "mobility")),
)
#: Populations by phrases, and by single words where no phrase is found.
POPULATIONS = {
    "youth": (("youth", "young people", "young adults", "teenagers", "adolescents", "children and youth", "at-risk youth", "disconnected youth", "opportunity youth", "youth ages", "children ages"), ("youth", "teen", "adolescent")),
    "low_income": (("low income", "low-income", "economically disadvantaged", "below poverty", "poverty level", "underserved communities", "under-resourced", "low income individuals", "low income families"), ("poverty",)),
    "women": (("women", "women and girls", "girls", "female", "gender equity", "women-led", "women-owned", "women of color", "gender-based"), ()),
    "veterans": (("veterans", "veteran", "military veterans", "service members", "military families", "armed forces"), ("veteran", "military")),
    "seniors": (("seniors", "older adults", "elderly", "aging adults", "senior citizens", "aging population", "older persons"), ("senior", "elderly", "aging")),
    "immigrants": (("immigrants", "immigrant communities", "refugees", "newcomers", "foreign-born", "asylum seekers", "undocumented", "limited english proficiency"), ("immigrant", "refugee", "newcomer", "asylum")),
    "people_with_disabilities": (("people with disabilities", "disability", "disabled", "special needs", "differently abled", "disability community"), ("disability", "disabled")),
    "rural_communities": (("rural communities", "rural populations", "rural areas", "frontier areas", "rural residents", "underserved rural", "rural and remote"), ("rural", "frontier")),
    "homeless": (("people experiencing homelessness", "homeless", "homelessness", "housing insecure", "unhoused", "street homeless"), ("homeless", "unhoused")),
    "black_community": (("black community", "african american", "african-american", "black residents", "black families", "black youth", "people of african descent", "historically black"), ()),
    "latino_community": (("latino", "hispanic", "latinx", "latina", "hispanic community", "spanish-speaking"), ()),
    "indigenous": (("native american", "indigenous", "tribal", "first nations", "alaska native", "american indian", "native hawaiian"), ("indigenous", "tribal", "native american")),
    "children": (("children", "kids", "minors", "infants", "toddlers", "young children", "children under"), ("children", "infant", "toddler")),
    "families": (("families", "family services", "family support", "low-income families", "at-risk families", "family strengthening", "family stability"), ("families", "family")),
    "pregnant_people": (("pregnant women", "pregnant people", "pregnant individuals", "expectant mothers", "new mothers", "postpartum women", "maternal"), ("pregnant", "expectant")),
    "students": (("students", "college students", "high school students", "student population", "k-12 students"), ("students", "scholars")),
    "public_agencies": (("public agencies", "local governments", "municipalities", "government entities", "state agencies", "units of government"), ("municipalities",)),
    "small_businesses": (("small businesses", "small business owners", "entrepreneurs", "startups", "small firms", "minority-owned businesses", "women-owned businesses", "microenterprises"), ()),
}


_ENTRY = "phrases:array<int>,words:array<int>"


def _numbered(entries: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> tuple[list[dict], list[str], list[str]]:
    """Entries by the places of their phrases in one list, and of the words that stand alone in another behind it; and both lists."""
    listed, alone = [p for phrases, _ in entries for p in phrases], [w for _, words in entries for w in words]
    rows, at, own = [], 0, len(listed)
    for phrases, words in entries:
        rows.append({"phrases": list(range(at, at + len(phrases))), "words": list(range(own, own + len(words)))})
        at, own = at + len(phrases), own + len(words)
    return rows, listed, alone


def domain_scores(text: Column) -> Column:
    """The score of each of DOMAINS in a lower-cased text: its weight for each phrase, or 0.4 of it, rounded, for any of its words."""
    rows, listed, alone = _numbered([(phrases, words) for *_, phrases, words in DOMAINS])
    rows = [{"weight": weight, "least": int(weight * 0.4 + 0.5), **row} for (_, _, weight, _, _), row in zip(DOMAINS, rows, strict=True)]

    def of(t: Column) -> Column:
        def score(e: Column) -> Column:
            hits = F.size(F.array_intersect(e["phrases"], t))
            return F.when(hits > 0, hits * e["weight"]).when(F.arrays_overlap(e["words"], t), e["least"]).otherwise(0)

        return F.transform(table(rows, f"array<struct<weight:int,least:int,{_ENTRY}>>"), score)

    return let(found(text, listed, alone), of)


def ranked(scores: Column, which: int) -> Column:
    """The domains (which = 0) or subdomains (1) with a score, best first; ties go to the one found first."""
    places: dict[str, list[int]] = {}
    for i, entry in enumerate(DOMAINS):
        places.setdefault(entry[which], []).append(i)
    names = table([{"name": name, "at": at} for name, at in places.items()], "array<struct<name:string,at:array<int>>>")

    def of(s: Column) -> Column:
        def row(n: Column) -> Column:
            found = F.filter(n["at"], lambda i: F.get(s, i) > 0)
            return F.struct((-F.aggregate(found, F.lit(0), lambda a, i: a + F.get(s, i))).alias("v"), F.array_min(found).alias("o"), n["name"].alias("name"))

        return F.transform(F.array_sort(F.filter(F.transform(names, row), lambda r: r["v"] < 0)), lambda r: r["name"])

    return let(scores, of)


def domain_phrases(text: Column) -> Column:
    """The domains' phrases that a lower-cased text holds, each once, in the table's order."""
    return contained(text, tuple(dict.fromkeys(p for e in DOMAINS for p in e[3])))


def population_tags(text: Column) -> Column:
    rows, listed, alone = _numbered(list(POPULATIONS.values()))
    entries = table([{"tag": tag, **row} for tag, row in zip(POPULATIONS, rows, strict=True)], f"array<struct<tag:string,{_ENTRY}>>")
    fits = lambda t, e: F.arrays_overlap(e["phrases"], t) | F.arrays_overlap(e["words"], t)
    return let(found(text, listed, alone), lambda t: F.transform(F.filter(entries, lambda e: fits(t, e)), lambda e: e["tag"]))


def mission_phrases(text: Column) -> Column:
    """The 15 mission phrases of the most weight that a lower-cased text holds."""
    return F.slice(contained(text, tuple(sorted(MISSION_PHRASES, key=lambda p: -MISSION_PHRASES[p]))), 1, 15)


def weak_words(text: Column, least: int) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: (F.length(w) > least) & ~w.isin(*GENERIC))


def generic_terms(title: Column) -> Column:
    return F.filter(F.split(F.lower(title), r"(?U)[\s\-/,()]+"), lambda w: (F.length(w) > 1) & w.isin(*GENERIC))
