"""The title-first scorer (V5): phrases derived from an organization's own texts are looked for in an opportunity's title, exactly and nearly.

Phrases, their synonyms and stems are derived once per organization, the words of a title once per opportunity; a pair compares short arrays. With
`interpreted`, the interpreter's applicants, description phrases and subdomains count as well.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round, let, normalize_phrase, strings, table
from .pairs import pair_up, spread
from .scoring_v2 import has

#: Mission phrases with their weights, in their order.
MISSION_PHRASES = {
    "maternal health equity": 20, "maternal health": 18, "birth equity": 18, "maternal mortality": 18, "prenatal care": 18, "postpartum care": 18, "reproductive health": 16, "birth outcomes": 16, "obstetric care": 16,
    "mental health equity": 18, "mental health": 16, "behavioral health": 16, "substance use disorder": 16, "substance abuse": 16, "addiction treatment": 16, "suicide prevention": 18, "crisis intervention": 16,
    "workforce development": 16, "job training": 16, "career development": 14, "employment services": 14, "vocational training": 16, "youth mentorship": 16, "youth development": 14, "after-school": 14,
    "affordable housing": 16, "homelessness prevention": 16, "housing assistance": 14, "permanent supportive housing": 18, "housing instability": 16,
    "clean energy": 16, "renewable energy": 16, "solar energy": 16, "wind energy": 16, "climate change": 14, "carbon reduction": 16, "greenhouse gas": 16, "sustainable technology": 16, "carbon emissions": 16,
    "decarbonization": 18, "clean technology": 16, "climate resilience": 16,
    "violence prevention": 16, "gun violence": 18, "domestic violence": 16, "community violence intervention": 20, "public safety": 12, "crime prevention": 16,
    "small business development": 18, "small business": 14, "entrepreneurship": 14, "commercialization": 16, "technology transfer": 16, "startup": 12, "sbir": 18, "sttr": 18,
    "stem education": 16, "early childhood education": 18, "k-12 education": 14, "higher education": 12, "arts education": 16, "coding education": 16, "literacy": 12,
    "health equity": 16, "public health": 12, "community health": 12, "health disparities": 16, "food security": 16, "food access": 16, "clean water": 16, "water quality": 16, "environmental justice": 16,
    "environmental health": 14, "veteran services": 16, "veteran housing": 18, "veteran mental health": 18, "immigrant services": 16, "refugee services": 16, "disability services": 14, "aging in place": 16,
    "senior services": 14, "legal aid": 16, "access to justice": 16, "criminal justice reform": 18, "digital equity": 16, "broadband access": 16, "agricultural technology": 16, "agritech": 16,
    "precision agriculture": 18, "economic development": 12, "community development": 10, "neighborhood revitalization": 16, "disaster relief": 14, "arts and culture": 14, "creative arts": 14, "performing arts": 14,
}
#: Title words that carry little meaning.
GENERIC = (
    "community support services innovation outcomes development improvement program initiative opportunity project grant award fund funding assistance "
    "advance enhance strengthen build improve increase promote provide access capacity impact new comprehensive integrated collaborative partnership "
    "national general based related special action activities solutions strategy approach effort focus delivery implementation planning coordination management "
    "local regional federal state public private"
).split()
#: Words that no phrase of a mission is made of.
CONNECTORS = (
    "a an the this that these those each all both some many most more very also of in on to by at as for with from into through within across about over under "
    "around between among against toward and or but nor so yet while although because since if when than such we our they their it its he she us who which what where that "
    "is are was were be been being have has had will can do does did provide provides providing serve serves serving help helps helping support supports supporting "
    "ensure ensures ensuring work works working focus focuses focusing promote promotes promoting advance advances advancing create creates creating enable enables enabling "
    "make makes making improve improves improving increase increases increasing including via using based"
).split()
#: Points of a match by the phrase's origin, exact and near.
POINTS = {"keyword": (45, 28), "program_area": (40, 24), "mission": (28, 17), "population": (12, 7)}
GLOBAL_EXACT, GLOBAL_NEAR, CONCEPT_WORD, DESCRIBED, SUBDOMAIN = 14, 7, 3, 18, 12
#: Phrases that stand for each other. A phrase of two groups has the siblings of the later one.
SYNONYMS = (
    ("workforce development", "workforce training", "workforce readiness", "workforce program", "workforce initiative"),
    ("job training", "career training", "skills training", "vocational training", "employment training", "job skills training"),
    ("youth workforce", "youth employment", "youth career", "youth careers", "young adult employment", "youth job"),
    ("youth development", "youth programs", "youth services", "youth opportunities", "youth engagement", "youth empowerment"),
    ("maternal health", "maternal care", "prenatal health", "maternal wellness", "maternal support"),
    ("mental health", "behavioral health", "mental wellness", "psychological health"),
    ("affordable housing", "housing affordability", "affordable homes", "low income housing", "low-income housing"),
    ("housing assistance", "housing support", "rental assistance", "housing services"),
    ("food security", "food access", "food insecurity", "food assistance", "food support"),
    ("clean energy", "renewable energy", "green energy", "sustainable energy"),
    ("renewable energy", "clean energy", "green energy", "solar energy", "wind energy"),
    ("climate change", "climate action", "climate resilience", "climate crisis", "climate adaptation"),
    ("stem education", "science education", "technology education", "stem learning", "stem program"),
    ("early childhood education", "early learning", "preschool education", "early childhood development"),
    ("digital equity", "digital access", "broadband access", "internet access", "technology access"),
    ("community health", "public health", "population health"),
    ("violence prevention", "violence reduction", "anti-violence"),
    ("criminal justice reform", "justice reform", "reentry programs", "criminal justice"),
    ("small business development", "business development", "entrepreneur support"),
    ("environmental justice", "environmental equity", "climate justice"),
    ("health equity", "health disparities", "health inequity"),
)
#: Populations and other words for them.
VARIANTS = (
    ("youth", ("young people", "young adults", "teens", "teenagers", "adolescents", "children and youth", "at-risk youth", "at risk youth")),
    ("young people", ("youth", "young adults", "teens", "adolescents")),
    ("low income", ("low-income", "economically disadvantaged", "underserved", "under-resourced", "low-wealth", "low income families")),
    ("low-income", ("low income", "economically disadvantaged", "underserved", "under-resourced")),
    ("underserved", ("under-resourced", "low income", "marginalized", "disadvantaged", "disinvested")),
    ("women", ("female", "women and girls", "girls", "womens")),
    ("veterans", ("veteran", "military veterans", "service members", "military families")),
    ("seniors", ("older adults", "elderly", "aging adults", "older people", "senior citizens", "aging population")),
    ("seniors", ("older adults", "elderly", "aging", "elders")),
    ("immigrants", ("immigrant", "refugee", "newcomers", "foreign-born", "refugees")),
    ("refugees", ("refugee", "immigrant", "asylum seekers", "displaced")),
    ("disabilities", ("disability", "people with disabilities", "disabled", "differently abled", "special needs")),
    ("rural", ("rural communities", "rural populations", "rural areas", "frontier")),
    ("homeless", ("homelessness", "housing insecure", "unhoused", "people experiencing homelessness")),
    ("black", ("african american", "black community", "black residents", "african-american")),
    ("latino", ("hispanic", "latinx", "latina", "latino", "hispanic community")),
    ("indigenous", ("native american", "tribal", "first nations", "alaska native", "american indian")),
    ("children", ("kids", "youth", "minors", "young children", "early childhood")),
)
#: Cues of title and eligibility for whom an opportunity is meant; most cues decide, then the order.
CUES = {
    "nonprofit": ("nonprofit", "non-profit", "501(c)(3)", "501c3", "community organization", "community-based organization", "cbo", "ngo", "charitable organization", "advocacy organization", "community service organization"),
    "small_business": ("small business", "sbir", "sttr", "startup", "commercialization", "entrepreneurship", "small disadvantaged business", "woman-owned", "minority-owned", "8(a) business", "business development", "small firm"),
    "university": ("university", "college", "academic institution", "higher education", "hbcu", "postsecondary", "institution of higher", "research university", "community college", "tribal college", "graduate school",
                   "undergraduate", "faculty", "research institution"),
    "government": ("local government", "state agency", "municipal", "county government", "city government", "public agency", "government agency", "state government", "units of government"),
    "tribal": ("tribal", "tribe", "indian tribe", "native american", "alaska native", "indigenous", "tribal nation", "federally recognized tribe", "tribal organization"),
    "contractor": ("contractor", "procurement", "solicitation", "rfp", "rfi", "contract opportunity", "acquisition", "vendor", "offeror", "prime contractor", "subcontractor", "sources sought"),
    "healthcare": ("hospital", "clinic", "health center", "healthcare provider", "health system", "medical center", "health care organization", "federally qualified health center", "fqhc", "rural health", "health care provider"),
    "individual": ("individual", "fellowship", "scholarship", "investigator", "student", "researcher", "doctoral", "postdoctoral", "early career"),
}
#: Points of a kind of organization for whom the opportunity is meant; whatever is missing counts as `any`.
FIT = {
    "nonprofit": {"nonprofit": 25, "any": 7, "healthcare": 15, "government": 8, "university": 8, "small_business": 4, "contractor": 2, "tribal": 10, "individual": 3},
    "small_business": {"small_business": 25, "contractor": 18, "any": 7, "government": 10, "nonprofit": 4, "university": 8, "healthcare": 6, "tribal": 8, "individual": 3},
    "university": {"university": 25, "individual": 14, "any": 7, "nonprofit": 10, "government": 8, "small_business": 8, "healthcare": 8, "contractor": 5, "tribal": 8},
    "government": {"government": 25, "tribal": 20, "any": 7, "nonprofit": 10, "university": 10, "small_business": 10, "healthcare": 10, "contractor": 12, "individual": 3},
    "tribal": {"tribal": 25, "government": 18, "nonprofit": 12, "any": 7, "university": 10, "small_business": 10, "healthcare": 10, "contractor": 5, "individual": 5},
    "healthcare": {"healthcare": 25, "nonprofit": 15, "any": 7, "government": 10, "university": 10, "small_business": 5, "contractor": 5, "tribal": 10, "individual": 8},
}
#: The largest values of the five dimensions; a preset is another such table.
CONFIG = {"title_mission_fit": 60, "org_type_fit": 25, "population_title_fit": 10, "geography_sanity": 5, "generic_penalty": 20}
DIMENSIONS = tuple(CONFIG)
TIERS = ((70, "excellent"), (55, "strong"), (38, "moderate"))
_WORD = "struct<w:string,s:string>"


def plain_phrase(text: str) -> str:
    """`normalize_phrase` of a parameter, on the driver."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", re.sub("[-–—]", " ", text.lower()))).strip()


#: Word endings in the order they are tried: ending, least length of the word, what replaces it.
_ENDINGS = (("ies", 6, "y"), ("ied", 6, "y"), ("ing", 7, ""), ("tion", 7, ""), ("ness", 7, ""), ("ment", 7, ""), ("al", 6, ""), ("ers", 6, "er"), ("es", 5, ""), ("s", 5, ""))


def plain_stem(word: str) -> str:
    for end, least, new in _ENDINGS:
        if len(word) >= max(5, least) and word.endswith(end):
            return word[: len(word) - len(end)] + new
    return word


def stem(word: Column) -> Column:
    """The word without its first fitting ending; words of fewer than five letters stay."""
    out = word
    for end, least, new in reversed(_ENDINGS):
        cut = F.concat(F.substr(word, F.lit(1), F.length(word) - len(end)), F.lit(new))
        out = F.when((F.length(word) >= max(5, least)) & word.endswith(end), cut).otherwise(out)
    return out


def siblings() -> dict[str, list[str]]:
    """Phrase → the other phrases of its group, of the later group where it is in two."""
    return {p: [s for s in group if s != p] for group in SYNONYMS for p in group}


def plain_words(phrase: str) -> list[str]:
    """The words of a normalized phrase that near matching compares."""
    return [w for w in phrase.split() if len(w) > 2 and w not in CONNECTORS]


def needed(n: int) -> int:
    """How many of n words a near match takes."""
    return 2 if n == 2 else math.ceil(n * 0.75)


def _specific(phrase: str) -> list[str]:
    return [w for w in phrase.split() if len(w) > 3 and w not in GENERIC]


def _pairs_of(words: list[str]) -> list[dict]:
    return [{"w": w, "s": plain_stem(w)} for w in words]


def _stemmed(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("w"), stem(w).alias("s")))


def _meaningful(words: Column, least: int) -> Column:
    return F.filter(words, lambda w: (F.length(w) > least) & ~w.isin(*GENERIC) & ~w.isin(*CONNECTORS))


def all_generic(phrase: Column) -> Column:
    words = F.filter(F.split(F.lower(phrase), r"(?U)\s+"), lambda w: F.length(w) > 1)
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*GENERIC))


def mission_ngrams(mission: Column) -> Column:
    """Pairs of neighbouring meaningful words at most 3 places apart, then triples within 5 places."""
    text = F.regexp_replace(F.regexp_replace(F.lower(mission), r"(?U)[^a-z\s'-]", " "), "['-]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: F.length(w) > 1)
    held = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].isin(*CONNECTORS) & (F.length(x["w"]) > 2))
    long = lambda x: F.when((F.length(x["w"]) > 3) & ~x["w"].isin(*GENERIC), 1).otherwise(0)

    def found(h: Column) -> Column:
        def two(x: Column, k: Column) -> Column:
            y = F.get(h, k + 1)
            return F.when((y["i"] - x["i"] <= 3) & ((F.length(x["w"]) > 3) | (F.length(y["w"]) > 3)), F.concat_ws(" ", x["w"], y["w"]))

        def three(x: Column, k: Column) -> Column:
            y, z = F.get(h, k + 1), F.get(h, k + 2)
            return F.when((z["i"] - x["i"] <= 5) & (long(x) + long(y) + long(z) >= 2), F.concat_ws(" ", x["w"], y["w"], z["w"]))

        return F.array_distinct(F.array_compact(F.concat(F.transform(h, two), F.transform(h, three))))

    return F.coalesce(let(held, found), strings(()))


def weighted_phrases(keywords: Column, areas: Column, mission: Column, populations: Column) -> Column:
    """The organization's phrases, array<struct<phrase, source>>, by falling weight; of equal phrases the first stays."""
    trimmed = lambda texts: F.transform(F.coalesce(texts, strings(())), lambda t: F.trim(F.lower(t)))

    def sourced(source: str, texts: Column) -> Column:
        good = F.filter(texts, lambda t: (F.length(t) > 2) & ~all_generic(t))  # pairs and triples of words are longer anyway
        return F.transform(good, lambda t: F.struct(normalize_phrase(t).alias("phrase"), F.lit(source).alias("source")))

    parts = [sourced("keyword", trimmed(keywords)), sourced("program_area", trimmed(areas)), sourced("mission", mission_ngrams(mission)), sourced("population", trimmed(populations))]
    return let(F.concat(*parts), lambda a: F.array_compact(F.transform(a, lambda x, k: F.when(~F.exists(F.slice(a, F.lit(1), k), lambda y: y["phrase"] == x["phrase"]), x))))


def user_type() -> Column:
    kind, mission = F.lower(F.coalesce("org_type", F.lit(""))), F.lower(F.coalesce("mission", F.lit("")))
    out = F.when((kind == "small_business") | F.coalesce("is_small_business", F.lit(False)), "small_business")
    for k in ("university", "government", "tribal", "healthcare"):
        out = out.when(kind == k, k)
    out = out.when((kind == "nonprofit") | F.coalesce("has_501c3", F.lit(False)), "nonprofit")
    return out.when(has(mission, "hospital", "clinic"), "healthcare").when(has(mission, "university", "college"), "university").otherwise("nonprofit")


def org_features(orgs: DataFrame) -> DataFrame:
    """One row per organization: id, name, phrases, concept words, overlapping mission phrases, populations, type and region."""
    groups = siblings()
    known = table({p: [plain_phrase(t) for t in s] for p, s in groups.items() if p == plain_phrase(p)}, "map<string,array<string>>")
    out = orgs.withColumn("plain", weighted_phrases(F.col("keywords"), F.col("program_areas"), F.col("mission"), F.col("population_served")))
    words = F.concat(_meaningful(F.flatten(F.transform("plain", lambda p: F.split(p["phrase"], " "))), 3), _meaningful(F.split(F.lower(F.coalesce("mission", F.lit(""))), "[^A-Za-z0-9_]+"), 4))
    out = out.withColumn("concepts", _stemmed(F.array_distinct(words)))
    listed = table([{"phrase": p, "words": _pairs_of(_specific(plain_phrase(p)))} for p in MISSION_PHRASES], f"array<struct<phrase:string,words:array<{_WORD}>>>")
    near = lambda c, w: (c["s"] == w["s"]) | c["w"].contains(w["w"]) | w["w"].contains(c["w"])
    overlap = F.filter(listed, lambda g: F.exists(g["words"], lambda w: F.exists("concepts", lambda c: near(c, w))))
    pair = lambda p: {"raw": p, "norm": plain_phrase(p)}
    first: dict[str, list[dict]] = {}
    back: dict[str, list[dict]] = {}
    for name, others in VARIANTS:
        first.setdefault(plain_phrase(name), [pair(v) for v in others])
        for v in dict.fromkeys(map(plain_phrase, others)):
            back.setdefault(v, []).append(pair(name))
    variants, canonical = (table(t, "map<string,array<struct<raw:string,norm:string>>>") for t in (first, back))
    none = F.expr("cast(array() as array<struct<raw:string,norm:string>>)")
    served = F.transform(F.coalesce("population_served", strings(())), normalize_phrase)
    places = F.transform(F.coalesce("geography", strings(())), F.lower)
    return out.select(
        "id",
        "name",
        user_type().alias("kind"),
        F.transform("plain", lambda p: F.struct(p["phrase"], p["source"], F.coalesce(F.try_element_at(known, p["phrase"]), strings(())).alias("siblings"), _stemmed(F.filter(F.split(p["phrase"], " "), lambda w: (F.length(w) > 2) & ~w.isin(*CONNECTORS))).alias("words"))).alias("phrases"),
        "concepts",
        F.transform(overlap, lambda g: g["phrase"]).alias("overlap"),
        F.transform(served, lambda p: F.struct(p.alias("pop"), F.coalesce(F.try_element_at(variants, p), none).alias("variants"), F.coalesce(F.try_element_at(canonical, p), none).alias("canonical"), F.filter(F.split(p, " "), lambda w: F.length(w) > 3).alias("words"))).alias("pops"),
        (F.exists(places, lambda g: has(g, "united states", "us", "usa", "america")) & ~F.exists(places, lambda g: has(g, "global", "international"))).alias("us_only"),
    )


def target_type(title: Column, eligibility: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, F.array_join(F.coalesce(eligibility, strings(())), " ")))
    rows = table([{"o": i, "kind": kind, "cues": cues} for i, (kind, cues) in enumerate(CUES.items())], "array<struct<o:int,kind:string,cues:array<string>>>")

    def best(t: Column) -> Column:
        counted = F.transform(rows, lambda r: F.struct((-F.size(F.filter(r["cues"], lambda c: t.contains(c)))).alias("n"), r["o"].alias("o"), r["kind"].alias("kind")))
        return F.array_min(counted)

    found = let(text, best)
    return F.when(found["n"] < 0, found["kind"]).otherwise("any")


def opp_features(opps: DataFrame, interpreted: bool = False) -> DataFrame:
    """One slim row per opportunity with all that a pair needs; with `interpreted`, opps come from the interpreter."""
    title = F.coalesce("title", F.lit(""))
    out = opps.withColumn("title_norm", normalize_phrase(title)).withColumn("title_all", F.split("title_norm", " ")).withColumn("title_stems", F.transform("title_all", stem))
    groups, rows = siblings(), []
    for phrase, weight in MISSION_PHRASES.items():
        norm, most = plain_phrase(phrase), 1.0 if weight >= 16 else 0.7
        words = plain_words(norm)
        rows.append({"phrase": phrase, "norm": norm, "full": math.floor(GLOBAL_EXACT * most + 0.5), "part": math.floor(GLOBAL_NEAR * most + 0.5), "siblings": [plain_phrase(s) for s in groups.get(norm, [])], "words": _pairs_of(words) if len(words) > 1 else [], "need": needed(len(words))})
    listed = table(rows, f"array<struct<phrase:string,norm:string,full:int,part:int,siblings:array<string>,words:array<{_WORD}>,need:int>>")
    hits = lambda g: F.size(F.filter(g["words"], lambda w: F.array_contains("title_all", w["w"]) | F.array_contains("title_stems", w["s"])))
    near = lambda g: F.exists(g["siblings"], lambda s: F.col("title_norm").contains(s)) | ((F.size(g["words"]) > 1) & (hits(g) >= g["need"]))
    exact = lambda g: F.col("title_norm").contains(g["norm"])
    found = F.transform(F.filter(listed, lambda g: exact(g) | near(g)), lambda g: F.struct(g["phrase"], g["norm"], exact(g).alias("exact"), F.when(exact(g), g["full"]).otherwise(g["part"]).alias("points")))
    low = F.lower(title)
    words = F.filter(F.split(low, r"(?U)[\s\-/,()]+"), lambda w: F.length(w) > 1)
    held = F.filter("title_all", lambda w: F.length(w) > 1)
    described = normalize_phrase(F.substring(F.coalesce("description", F.lit("")), 1, 500)) if interpreted else F.lit("")
    out = out.withColumn("desc_norm", described)
    more = ["applicants", "applicant_confidence", "desc_phrases", "subdomains", F.transform("subdomains", normalize_phrase).alias("subdomain_norms")] if interpreted else []
    return out.select(
        "id",
        "ord",
        "source",
        "title_norm",
        "title_all",
        "title_stems",
        found.alias("globals"),
        target_type(title, F.col("eligibility")).alias("target"),
        (F.lower(F.coalesce("source", F.lit(""))).contains("ted_eu") | has(low, "european union", "ted eu", "ukri")).alias("european"),
        F.size(words).alias("n_words"),
        F.size(F.filter(words, lambda w: w.isin(*GENERIC))).alias("n_generic"),
        F.when(F.size(held) > 0, F.size(F.filter(held, lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC))) / F.size(held)).otherwise(0.0).alias("specificity"),
        "desc_norm",
        F.concat_ws(" ", "title_norm", F.when(F.col("desc_norm") != "", F.col("desc_norm"))).alias("text_norm"),
        *more,
    )


def pairs(opps: DataFrame, orgs: DataFrame, interpreted: bool = False) -> DataFrame:
    return pair_up(opp_features(opps if interpreted else spread(opps), interpreted), org_features(orgs))


def _near(phrase: Column) -> Column:
    n, words = F.size(phrase["words"]), phrase["words"]
    hits = F.size(F.filter(words, lambda w: F.array_contains("title_all", w["w"]) | F.array_contains("title_stems", w["s"])))
    return F.exists(phrase["siblings"], lambda s: F.col("title_norm").contains(s)) | ((n >= 2) & (hits >= F.when(n == 2, 2).otherwise(F.ceil(n * 0.75))))


def _points(phrases: Column, which: int) -> Column:
    def of(p: Column) -> Column:
        out = F.lit(0)
        for source, values in POINTS.items():
            out = F.when(p["source"] == source, values[which]).otherwise(out)
        return out

    return F.aggregate(phrases, F.lit(0), lambda a, p: a + of(p))


def _outer(names: Column) -> Column:
    """The phrases that are not part of a longer one."""
    return let(names, lambda a: F.filter(a, lambda p: ~F.exists(a, lambda o: (F.length(o) > F.length(p)) & o.contains(p))))


def score_v5(pairs: DataFrame, config: dict[str, int] = CONFIG, interpreted: bool = False) -> DataFrame:
    """Adds the four dimensions, generic_penalty, total, confidence, target, fit_category, reasons and risks. Every pair is eligible."""
    c, size = F.col, F.size
    title = c("title_norm")
    out = pairs.withColumn("hits", F.filter("org_phrases", lambda p: title.contains(p["phrase"])))
    longer = lambda a, x, k: F.exists(F.slice(a, F.lit(1), k), lambda y: y["phrase"].contains(x["phrase"]) & (F.length(y["phrase"]) > F.length(x["phrase"])))
    out = out.withColumn("exact", F.array_compact(F.transform("hits", lambda x, k: F.when(~longer(c("hits"), x, k), x))))
    out = out.withColumn("near", F.filter("org_phrases", lambda p: ~title.contains(p["phrase"]) & _near(p)))
    names = lambda a: F.transform(a, lambda p: p["phrase"])
    out = out.withColumn("credited", F.concat(names("exact"), names("near")))
    out = out.withColumn("fallback", F.filter("globals", lambda g: F.array_contains("org_overlap", g["phrase"]) & ~F.array_contains("credited", g["norm"])))
    said = F.flatten(F.transform("exact", lambda p: F.split(p["phrase"], " ")))
    out = out.withColumn("said", said).withColumn("words", F.slice(F.filter("org_concepts", lambda w: ~F.array_contains("said", w["w"]) & (F.array_contains("title_all", w["w"]) | F.array_contains("title_stems", w["s"]))), 1, 3))
    bonus = F.lit(0)
    if interpreted:
        used = F.concat("credited", F.transform("fallback", lambda g: g["norm"]))
        described = F.exists("desc_phrases", lambda d: ~F.array_contains(used, d["norm"]) & F.array_contains("org_overlap", d["phrase"]))
        sub = F.exists("subdomain_norms", lambda t: F.exists("org_concepts", lambda w: t.contains(w["s"])))
        bonus = F.when(described, DESCRIBED).otherwise(0) + F.when(sub, SUBDOMAIN).otherwise(0)
    raw = F.least(F.lit(60), _points(c("exact"), 0) + _points(c("near"), 1) + F.aggregate("fallback", F.lit(0), lambda a, g: a + g["points"]) + CONCEPT_WORD * size("words") + bonus)

    target = c("target")
    if interpreted:
        first = c("applicants")[0]
        target = F.when(c("applicant_confidence") >= 40, F.when(first.isin(*FIT["nonprofit"]), first).otherwise("any")).otherwise(target)
    points = table({f"{k} {t}": row.get(t, row["any"]) for k, row in FIT.items() for t in (*CUES, "any")}, "map<string,int>")
    fit = F.try_element_at(points, F.concat_ws(" ", "org_kind", "target"))
    out = out.withColumn("target", target).withColumn("fit", fit)

    text, wide = c("text_norm"), c("desc_norm") != ""
    seen = lambda p: F.when(F.exists(p["variants"], lambda v: title.contains(v["norm"])), 8).when(wide & F.exists(p["variants"], lambda v: text.contains(v["norm"])), 6).otherwise(0)
    value = lambda p: F.greatest(F.when(title.contains(p["pop"]), 10).otherwise(0), F.when(wide & text.contains(p["pop"]), 8).otherwise(0), seen(p), F.when(F.exists(p["canonical"], lambda v: title.contains(v["norm"])), 8).otherwise(0), F.when(F.exists(p["words"], lambda w: title.contains(w)), 5).otherwise(0))
    population = F.coalesce(F.array_max(F.transform("org_pops", value)), F.lit(0))

    most = {k: F.lit(config[k]) for k in DIMENSIONS}
    geography = F.when(c("org_us_only") & c("european"), js_round(most["geography_sanity"] * 0.2)).otherwise(js_round(most["geography_sanity"] * 0.85))
    ratio = F.when(c("n_words") > 0, c("n_generic") / c("n_words")).otherwise(0.0)
    any_exact, any_match = size("exact") > 0, (size("credited") > 0) | (size("fallback") > 0)
    factor = F.when(any_exact, 0.25).when(any_match, 0.60).when(ratio >= 0.50, 1.40).otherwise(1.00)
    base = F.when(ratio >= 0.20, js_round((ratio - 0.20) / 0.50 * most["generic_penalty"])).otherwise(0)
    out = out.withColumns({
        "title_mission_fit": js_round(raw / 60 * most["title_mission_fit"]),
        "org_type_fit": js_round(c("fit") / 25 * most["org_type_fit"]),
        "population_title_fit": js_round(population / 10 * most["population_title_fit"]),
        "geography_sanity": geography,
        "generic_penalty": F.least(most["generic_penalty"], js_round(base * factor)),
    })
    out = out.withColumns({d: c(d).cast("long") for d in DIMENSIONS})
    total = c("title_mission_fit") + c("org_type_fit") + c("population_title_fit") + c("geography_sanity") - c("generic_penalty")
    out = out.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long"))
    tier = F.lit("weak")
    for least, name in reversed(TIERS):
        tier = F.when(c("total") >= least, name).otherwise(tier)
    category = F.when(c("fit") >= 22, "exact").when(c("fit") >= 15, "compatible").when(c("fit") >= 8, "neutral").when(c("fit") >= 5, "mismatch").otherwise("strong_mismatch")
    out = out.withColumn("confidence", tier).withColumn("fit_category", category)

    two = lambda a: F.array_join(F.slice(a, 1, 2), ", ")
    full = F.transform(F.filter("fallback", lambda g: g["exact"]), lambda g: g["phrase"])
    mission = (
        F.when(any_exact, F.concat(F.lit("Org mission phrase in title: "), two(_outer(names("exact")))))
        .when(size("near") > 0, F.concat(F.lit("Near-match to org phrase in title: "), two(_outer(names("near")))))
        .when(size(full) > 0, F.concat(F.lit("Related domain phrase in title: "), two(full)))
    )
    concept = F.when(size("words") > 0, F.concat(F.lit("Org focus area words in title: "), F.array_join(F.transform("words", lambda w: w["w"]), ", ")))
    kind = F.when(category == "exact", F.concat(F.lit("Strong org-type match: "), "org_kind", F.lit(" = intended applicant"))).when(category == "compatible", F.concat(F.lit("Compatible org-type: "), "org_kind", F.lit(" can competitively apply")))
    mismatch = F.when(c("fit") < 8, F.when(c("target") != "any", F.concat(F.lit("Opportunity targets "), "target", F.lit("s — org type is "), "org_kind")).otherwise("No org-type cues found in title or eligibility"))
    generic = F.when(
        c("generic_penalty") >= math.floor(config["generic_penalty"] * 0.6 + 0.5),
        F.concat(F.lit("Title is highly generic ("), js_round(c("specificity") * 100).cast("string"), F.lit("% specific) — low ranking signal")),
    )
    served = F.when(c("population_title_fit") >= 7, F.concat(F.lit("Served population found in title: "), _named_populations(title, text, wide)))
    reasons = F.array_compact(F.array(mission, concept, kind, served))
    risks = F.array_compact(F.array(F.when(~any_match, "No org mission concept found in title — check full description before applying"), generic, mismatch))
    return out.withColumn("reasons", reasons).withColumn("risks", risks).withColumn("passes_eligibility", F.lit(True)).drop("hits", "exact", "near", "credited", "fallback", "said", "words", "globals", "fit")


def _named_populations(title: Column, text: Column, wide: Column) -> Column:
    """The first two populations found, as themselves and then by another name, up to the first that the title has as such."""
    exact = F.transform("org_pops", lambda p: title.contains(p["pop"]))
    upto = F.array_position(exact, True)
    before = F.when(upto > 0, F.slice("org_pops", 1, F.greatest(upto - 1, F.lit(0)).cast("int"))).otherwise(F.col("org_pops"))
    hit = F.when(upto > 0, F.array(F.get("org_pops", (upto - 1).cast("int"))["pop"])).otherwise(strings(()))
    own = F.concat(F.transform(F.filter(before, lambda p: wide & text.contains(p["pop"])), lambda p: F.concat(p["pop"], F.lit(" (desc)"))), hit)

    def other(p: Column) -> Column:
        name = lambda v, more: F.concat(p["pop"], F.lit(' ≈ "'), v["raw"], F.lit('"' + more))
        in_title, in_text = F.filter(p["variants"], lambda v: title.contains(v["norm"])), F.filter(p["variants"], lambda v: text.contains(v["norm"]))
        found = F.when(F.size(in_title) > 0, F.array(name(F.get(in_title, F.lit(0)), ""))).when(wide & (F.size(in_text) > 0), F.array(name(F.get(in_text, F.lit(0)), " (desc)"))).otherwise(strings(()))
        return F.concat(found, F.transform(F.filter(p["canonical"], lambda v: title.contains(v["norm"])), lambda v: name(v, "")))

    return F.array_join(F.slice(F.concat(own, F.flatten(F.transform(before, other))), 1, 2), ", ")
