"""Interpretation of an opportunity's own text: cleaned title, domains, activities, populations, intended organizations, signals, type and geographic scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import tags
from ..functions.phrases import found
from ..functions.text import let, strings, table
from . import taxonomy as tx
from .pairs import spread
from .scoring_v2 import has
from .scoring_v5 import plain_phrase

#: Bureaucratic prefixes of titles, tried in order.
PREFIXES = (
    r"(?i)^fy\s*\d{2,4}[-–:\s]+",
    r"(?i)^fiscal\s+year\s+\d{4}[-–:\s]+",
    r"(?i)^(?:nofo|noa|nosi|foa|baa)[-–:\s]+",
    r"(?i)^(?:rfp|rfi|rfa|rfq)\s*#?\s*[\w-]*[-–:\s]+",
    r"(?i)^cfda\s*[\d.]+[-–:\s]+",
    r"(?i)^(?:solicitation|announcement|notice)\s*(?:of\s+funding\s+(?:opportunity|availability))?[-–:\s]+",
    r"(?i)^funding\s+opportunity\s+announcement[-–:\s]+",
    r"(?i)^broad\s+agency\s+announcement[-–:\s]+",
    r"(?i)^sources\s+sought[-–:\s]+",
    r"^\d{4}-\d{3,6}[-–:\s]+",
    r"^[A-Z]{1,4}\d{2}[-–]\w{1,8}[-–:\s]+",
    r"(?i)^(?:opportunity|program)\s+(?:number|no\.?)\s*[\w-]+[-–:\s]+",
)
SUFFIX = r"\s*[-–(]\s*[A-Z0-9]{4,}\s*\)?\s*$"
#: Activities by phrase, and by keyword where no phrase is found.
ACTIVITIES = {
    "service_delivery": (("direct services", "service delivery", "program delivery", "direct program", "client services"), ()),
    "capacity_building": (("capacity building", "organizational capacity", "capacity development", "strengthen organizations", "institutional strengthening", "organizational strengthening"), ("capacity",)),
    "technical_assistance": (("technical assistance", "technical support", "training and technical assistance", "ta services", "consulting services", "coaching and mentoring"), ("technical assistance",)),
    "research": (("research and development", "applied research", "basic research", "demonstration research", "evidence generation", "research project", "evaluation research", "randomized controlled"), ("research", "study", "investigation")),
    "training": (("job training", "workforce training", "skills training", "professional development", "training program", "job readiness training", "occupational training", "job skills training"), ("training", "instruction", "learning")),
    "pilot": (("pilot program", "pilot project", "demonstration project", "proof of concept", "innovation pilot", "pilot initiative", "test and learn"), ("pilot", "prototype", "demonstration")),
    "planning": (("strategic planning", "community planning", "project planning", "feasibility study", "needs assessment", "comprehensive plan", "action plan"), ("planning", "assessment", "feasibility")),
    "implementation": (("program implementation", "project implementation", "scale up", "scale-up", "full implementation"), ("implement", "execute", "deploy")),
    "commercialization": (("commercialization", "technology transfer", "market entry", "market development", "product development", "business development", "go-to-market"), ("commercialization", "licensing")),
    "procurement": (("procurement", "acquisition", "solicitation", "sources sought", "request for proposal", "request for information", "contract award", "indefinite delivery"), ("procurement", "solicitation", "acquisition", "rfp", "rfi")),
    "outreach": (("community outreach", "outreach and engagement", "community engagement", "public awareness", "stakeholder engagement", "public education campaign"), ("outreach", "awareness", "engagement")),
    "infrastructure": (("infrastructure development", "capital improvement", "facilities development", "construction", "renovation", "capital project", "physical infrastructure"), ("infrastructure", "capital", "construction", "renovation")),
    "advocacy": (("policy advocacy", "systems change", "policy reform", "legislative advocacy", "systems advocacy"), ("advocacy", "systemic", "reform")),
}
#: Kinds of organization by phrases of eligibility, title and description, and the sources that favour them.
APPLICANTS = {
    "nonprofit": (("nonprofit", "non-profit", "501(c)(3)", "501c3", "cbo", "community-based organization", "charitable", "tax-exempt", "charitable organization"), ("community organization", "nonprofit organization"),
                  ("community organizations", "nonprofit organizations", "community-based organizations", "cbos"), ("simpler_grants", "threesixtygiving")),
    "small_business": (("small business", "small disadvantaged business", "8(a)", "woman-owned small business", "hubzone", "service-disabled", "wosb", "sdvosb"), ("small business", "sbir", "sttr", "startup", "entrepreneur"),
                       ("small businesses", "small firms", "startup companies", "commercial entities"), ("sbir", "sam_gov")),
    "university": (("university", "college", "institution of higher education", "ihe", "hbcu", "minority serving institution", "msi", "tribal college", "academic institution"), ("research university", "higher education", "hbcu", "academic"),
                   ("universities", "colleges", "academic institutions", "research universities"), ()),
    "local_government": (("local government", "municipality", "city government", "county government", "units of local government", "general purpose local government", "public body"), ("local government", "municipal", "county", "city of"),
                         ("local governments", "municipalities", "cities and counties", "units of government"), ("california_grants",)),
    "state_government": (("state government", "state agency", "state department", "state workforce agency", "state health department"), ("state agency", "state government", "state department"), ("state agencies", "state governments", "state departments"), ()),
    "tribal": (("tribal", "tribe", "federally recognized tribe", "indian tribe", "alaska native", "native american", "tribal organization"), ("tribal organization", "tribal nation", "native american"), ("tribal nations", "tribal organizations", "native communities"), ()),
    "healthcare_provider": (("hospital", "clinic", "federally qualified health center", "fqhc", "rural health clinic", "community health center", "healthcare provider", "health system"), ("health center", "fqhc", "rural health center"),
                            ("health centers", "fqhcs", "healthcare providers", "hospitals", "clinics"), ()),
    "contractor": (("contractor", "prime contractor", "all responsible sources", "sources sought", "offeror", "vendor"), ("contract", "procurement", "acquisition", "solicitation"), ("contractors", "vendors", "offerors"), ("sam_gov", "ted_eu")),
    "research_institution": (("research institution", "research organization", "not-for-profit research organization", "research center"), ("research institution", "research center"), ("research institutions", "research organizations"), ()),
}
#: The scope of sources.
SCOPES = {"world_bank": "international", "ted_eu": "international", "threesixtygiving": "national", "sbir": "national", "sam_gov": "national", "grants_gov": "national", "simpler_grants": "national", "california_grants": "state"}


def clean_title(title: Column) -> Column:
    """The title without prefixes, as long as more than ten characters remain each time, and without a trailing code."""

    def shorten(t: Column, prefix: Column) -> Column:
        shorter = F.trim(F.regexp_replace(t, prefix, F.lit("")))
        return F.when(F.length(shorter) > 10, shorter).otherwise(t)

    out = F.aggregate(strings(PREFIXES), F.trim(F.coalesce(title, F.lit(""))), shorten)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, SUFFIX, "")), r"\s{2,}", " "))


def activity_tags(text: Column) -> Column:
    """The tags of which a lower-cased text holds a phrase or a word."""
    return tags(text, {tag: [*phrases, *words] for tag, (phrases, words) in ACTIVITIES.items()})


def intended_applicants(source: Column, eligibility: Column, title: Column, description: Column) -> Column:
    """Up to three kinds of organization with more than eight votes, most votes first; ties go to the kind that got its first vote first; `any` without any."""
    primary = F.lit(None).cast("string")
    for kind, (*_, sources) in reversed(APPLICANTS.items()):
        primary = F.when(source.isin(*sources), kind).otherwise(primary) if sources else primary
    said = [p for *_, by_text, _ in APPLICANTS.values() for p in by_text]

    def best(at: Column) -> Column:
        ranked, upto = [], 0
        for i, (kind, (by_eligibility, by_title, by_text, sources)) in enumerate(APPLICANTS.items()):
            first, upto = upto, upto + len(by_text)
            told = F.arrays_overlap(at, F.lit(list(range(first, upto))))
            favoured = source.isin(*sources) if sources else F.lit(False)
            votes = F.when(favoured, F.when(primary == kind, 30).otherwise(15)).otherwise(0)
            votes = votes + F.when(has(eligibility, *by_eligibility), 20).otherwise(0) + F.when(has(title, *by_title), 10).otherwise(0) + F.when(told, 6).otherwise(0)
            order = F.when(primary == kind, 0).when(favoured, 1).otherwise(2) * 100 + i
            ranked.append(F.when(votes > 8, F.struct((-votes).alias("v"), order.alias("o"), F.lit(kind).alias("kind"))))
        return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*ranked))), 1, 3), lambda r: r["kind"])

    return let(let(found(description, said), best), lambda b: F.when(F.size(b) > 0, b).otherwise(strings(("any",))))


def _signals(scores: str, phrases: str, weak: Column) -> Column:
    top = lambda a, n: F.slice(a, 1, n)
    return F.struct(
        top(F.col(phrases), 8).alias("strong"), top(F.array_distinct(weak), 8).alias("weak"), top(tx.ranked(F.col(scores), 1), 5).alias("exact"), top(tx.ranked(F.col(scores), 0), 5).alias("near")
    )


def interpret(opps: DataFrame) -> DataFrame:
    """Adds clean_title, domains, subdomains, activities, populations, applicants, type, scope, places, phrases and signals of title and description,
    and the confidences (in hundredths) of domains, activities, populations and applicants.

    The description counts if it has more than 20 characters; its signals come from its first 2000. desc_phrases are (phrase, norm) of the description
    that the title does not hold.
    """
    out = spread(opps).withColumn("clean_title", clean_title(F.col("title")))
    text = F.trim("description")
    # Columns of their own: each is used by many expressions, and would be computed anew for every phrase that is looked for.
    out = out.withColumns({"_low": F.lower("clean_title"), "_eligible": F.lower(F.array_join("eligibility", " ")), "_body": F.when(F.length(text) > 20, text).otherwise("")})
    out = out.withColumns({"_text": F.lower("_body"), "_all": F.lower(F.concat_ws(" ", "clean_title", "clean_title", "_body"))})
    title, eligibility, body, low, source = (F.col(c) for c in ("_low", "_eligible", "_body", "_text", "source"))
    kind = (
        F.when(source == "sbir", "research_grant")
        .when(source.isin("sam_gov", "ted_eu"), F.when(has(eligibility, "contractor", "solicitation") | title.contains("contract"), "procurement").otherwise("contract"))
        .when(source == "world_bank", "international_funding")
        .when(has(title, "fellowship", "scholarship"), "fellowship")
        .when(has(title, "loan", "revolving fund"), "loan")
        .when(has(title, "challenge", "prize"), "challenge")
        .when(title.contains("technical assistance") | eligibility.contains("technical assistance"), "technical_assistance")
        .when(F.col("funding_type") == "contract", "contract")
        .otherwise("grant")
    )
    places = F.transform("geography", F.lower)
    field = F.when(F.exists(places, lambda g: has(g, "international", "global", "world", "overseas")), "international").when(F.exists(places, lambda g: (F.length(g) < 15) & ~g.isin("national", "federal")), "state").otherwise("national")
    cue = F.when(has(title, "national", "federal"), "national").when(title.contains("state"), "state").when(has(title, "local", "community", "city", "county"), "local").otherwise("unknown")
    by_source = F.try_element_at(F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair]), source)
    out = out.withColumns({
        "activities": activity_tags(F.lower(F.concat_ws(" ", "clean_title", body))),
        "applicants": intended_applicants(source, eligibility, title, low),
        "type": kind,
        "scope": F.coalesce(by_source, F.when(F.size("geography") > 0, field).otherwise(cue)),
    })
    opening, whole = F.substring(low, 1, 2000), F.col("_all")
    out = out.withColumns({
        "_title": tx.domain_scores(title), "_opening": tx.domain_scores(opening), "_whole": tx.domain_scores(whole),
        "_title_phrases": tx.domain_phrases(title), "_opening_phrases": tx.domain_phrases(opening),
        "_title_mission": tx.mission_phrases(title), "_text_mission": tx.mission_phrases(low),
        "_people": F.array_distinct(F.concat(tx.population_tags(title), tx.population_tags(low))),
    })
    out = out.withColumns({"_domains": tx.ranked(F.col("_whole"), 0), "_subdomains": tx.ranked(F.col("_whole"), 1)})
    weak_title = F.filter(tx.weak_words(title, 3), lambda w: ~F.exists("_title_phrases", lambda p: p.contains(w)))
    none = strings(())
    signals = _signals("_opening", "_opening_phrases", F.slice(tx.weak_words(opening, 4), 1, 20))
    described = F.slice(F.array_except("_text_mission", "_title_mission"), 1, 8)
    norms = table({p: plain_phrase(p) for p in tx.MISSION_PHRASES}, "map<string,string>")
    spaced = F.transform("_subdomains", lambda s: F.replace(s, F.lit("_"), F.lit(" ")))
    here = F.when(by_source.isNotNull(), F.when(F.size("geography") > 0, F.col("geography")).otherwise(F.array(by_source))).when(F.size("geography") > 0, F.col("geography")).when(F.col("scope") == "unknown", none).otherwise(F.array("scope"))
    share = lambda n: F.least(F.lit(100), n * 50)
    out = out.withColumns({
        "domains": F.slice("_domains", 1, 8), "subdomains": F.slice("_subdomains", 1, 8), "populations": F.slice("_people", 1, 8), "places": here,
        "mission_phrases": F.slice(F.concat("_title_mission", spaced), 1, 12), "all_phrases": F.slice(F.array_distinct(F.concat("_title_mission", "_text_mission")), 1, 12),
        "desc_phrases": F.transform(described, lambda p: F.struct(p.alias("phrase"), norms[p].alias("norm"))), "generic_terms": tx.generic_terms(F.col("clean_title")),
        "title_signals": _signals("_title", "_title_phrases", weak_title), "description_signals": F.when(body != "", signals).otherwise(F.struct(none.alias("strong"), none.alias("weak"), none.alias("exact"), none.alias("near"))),
        "domain_confidence": share(F.size("_domains")), "activity_confidence": share(F.size("activities")), "population_confidence": share(F.size("_people")),
        "applicant_confidence": F.when(F.col("applicants")[0] == "any", 20).otherwise(share(F.size("applicants"))),
    })
    out = out.withColumn("activities", F.slice("activities", 1, 6))
    return out.drop("_low", "_eligible", "_body", "_text", "_all", "_title", "_opening", "_whole", "_title_phrases", "_opening_phrases", "_title_mission", "_text_mission", "_people", "_domains", "_subdomains")
