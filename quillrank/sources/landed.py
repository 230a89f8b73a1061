"""Landed source payloads (JSON text) to canonical records.

Each source is described by the JSON paths that feed each column, tried in order. A payload is parsed once, into a variant, and each path is looked up in that. Rows without a record
id are dropped, as are rows of unknown sources and unreadable payloads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedupe_key, parse_amount, record_id_hash, strings

_US = ("United States",)
#: The fields of each source's payload. A path in a list is a fallback for those before it; `=` marks a constant.
FIELDS: dict[str, dict] = {
    "simpler_grants": {
        "id": ["opportunity_id", "legacy_opportunity_id"], "title": ["opportunity_title", "=Untitled"], "description": ["summary.summary_description"], "agency": ["agency_name", "top_level_agency_name"],
        "funding_type": ["=grant"], "status": ["opportunity_status"], "open_date": ["summary.post_date"], "close_date": ["summary.close_date", "summary.forecasted_close_date"],
        "min_award": ["summary.award_floor"], "max_award": ["summary.award_ceiling", "summary.estimated_total_program_funding"], "eligibility": ["summary.applicant_types"], "categories": ["category"],
        "geography": _US, "url": ["=https://simpler.grants.gov/opportunity/{id}"],
    },
    "grants_gov": {
        "id": ["id", "oppNum"], "title": ["title", "oppTitle", "=Untitled"], "description": ["synopsis", "description"], "agency": ["agencyName", "agency"], "funding_type": ["fundingCategory", "=grant"],
        "status": ["oppStatus"], "open_date": ["openDate"], "close_date": ["closeDate", "deadlineDate"], "min_award": ["awardFloor"], "max_award": ["awardCeiling"], "eligibility": ["eligibility"],
        "categories": ["fundingCategory"], "geography": _US, "url": ["=https://www.grants.gov/search-results-detail/{id}"],
    },
    "sam_gov": {
        "id": ["noticeId", "solicitationNumber"], "title": ["title", "=Untitled"], "description": ["description", "synopsis"], "agency": ["fullParentPathName", "organizationHierarchy[0].name"], "funding_type": ["type", "=contract"],
        "status": ["active"], "open_date": ["postedDate"], "close_date": ["responseDeadLine", "archiveDate"], "min_award": [], "max_award": ["baseAndAllOptionsValue"], "eligibility": ["typeOfSetAside"],
        "categories": ["naicsCode"], "geography": _US, "url": ["uiLink", "=https://sam.gov/opp/{id}/view"],
    },
    "sbir": {
        "id": ["solicitation_id", "program_solicitation_id", "solicitation_number"], "title": ["solicitation_title", "program_title", "=Untitled"], "description": ["program_description", "abstract"], "agency": ["agency", "branch"],
        "funding_type": ["program"], "status": [], "open_date": ["open_date", "release_date"], "close_date": ["close_date", "submission_deadline"], "min_award": [], "max_award": ["award_ceiling", "program_year_1_funding"],
        "eligibility": ("small_business",), "categories": ["program_solicitation_agency_interest_area", "technology_topic"], "geography": _US, "url": ["solicitation_link", "=https://www.sbir.gov/solicitations"],
    },
    "threesixtygiving": {
        "id": ["['Identifier']", "id"], "title": ["['Title']", "title", "=Untitled"], "description": ["['Description']", "description"], "agency": ["['Funding Org:Name']", "fundingOrganization.name"], "funding_type": ["=grant"],
        "status": ["=active"], "open_date": ["['Award Date']"], "close_date": [], "min_award": ["['Amount Applied For']"], "max_award": ["['Amount Awarded']"], "eligibility": (),
        "categories": ["['Grant Programme:Title']"], "geography": ("United Kingdom",), "url": ["['URL']", "=https://grantsnav.threesixtygiving.org/"],
    },
    "california_grants": {
        "id": ["id", "grant_id"], "title": ["title", "grant_title", "=Untitled"], "description": ["description", "purpose"], "agency": ["agency", "administering_agency"], "funding_type": ["=grant"], "status": ["status", "=active"],
        "open_date": ["published_date"], "close_date": ["deadline", "due_date"], "min_award": ["funding_minimum", "min_award"], "max_award": ["funding_maximum", "max_award"], "eligibility": ["applicant_type", "eligibility"],
        "categories": ["category", "funding_area"], "geography": ("California", "United States"), "url": ["url", "link", "=https://www.grants.ca.gov/grants/{id}/"],
    },
    "world_bank": {
        "id": ["id"], "title": ["title", "project_name", "=Untitled"], "description": ["project_abstract", "description"], "agency": ["borrower", "ibrd_country"], "funding_type": ["=procurement"], "status": ["status", "=active"],
        "open_date": ["boardapprovaldate", "approvaldate"], "close_date": ["closingdate"], "min_award": [], "max_award": ["totalamt", "lendprojectcost"], "eligibility": (), "categories": ["theme_namecode", "sector_namecode"],
        "geography": ["countryname", "=International"], "url": ["url", "=https://projects.worldbank.org/en/projects-operations/project-detail/{id}"],
    },
    "ted_eu": {
        "id": ["['publication-number']", "noticeNumber", "ND"], "title": ["['BT-21-Procedure']"], "description": ["['BT-02-notice']", "shortDescription[0].value", "description"], "agency": ["buyer[0].officialName", "CA"], "funding_type": ["=procurement"],
        "status": ["=active"], "open_date": ["['BT-05(a)-notice']", "publicationDate"], "close_date": ["deadline", "DT"], "min_award": [], "max_award": ["totalValueOfBusiness", "contractValue"], "eligibility": (),
        "categories": ["mainCpvCode.codeValue"], "geography": ["isoCountry", "=European Union"], "url": ["links.pdf.ENG", "links.html.ENG", "=https://ted.europa.eu/en/notice/{id}"],
    },
    "usaspending": {
        "id": ["['Award ID']", "award_id"], "title": ["['Recipient Name']", "recipient_name", "=Unnamed Recipient"], "description": ["['Description']", "description"], "agency": ["['Awarding Agency']", "awarding_agency_name"],
        "funding_type": ["['Award Type']", "=grant"], "status": ["=archived"], "open_date": ["['Start Date']"], "close_date": ["['End Date']"], "min_award": ["['Award Amount']"], "max_award": ["['Award Amount']"], "eligibility": (),
        "categories": (), "geography": _US, "url": ["=https://www.usaspending.gov/award/{url_id}"],
    },
    "nih_reporter": {
        "id": ["project_num"], "title": ["project_title", "=Untitled Project"], "description": ["abstract_text"], "agency": ["agency_code", "organization.org_name"], "funding_type": ["=grant"], "status": ["=archived"],
        "open_date": ["project_start_date"], "close_date": ["project_end_date"], "min_award": [], "max_award": ["award_amount"], "eligibility": (), "categories": (), "geography": _US, "url": ["=https://reporter.nih.gov/search/{url_id}"],
    },
    "nsf_awards": {
        "id": ["id"], "title": ["title", "=Untitled"], "description": ["abstractText"], "agency": ["=NSF"], "funding_type": ["=grant"], "status": ["=archived"], "open_date": ["startDate"], "close_date": ["expDate"],
        "min_award": [], "max_award": ["fundsObligatedAmt"], "eligibility": (), "categories": (), "geography": _US, "url": ["=https://www.nsf.gov/awardsearch/showAward?AWD_ID={id}"],
    },
}
_HISTORICAL = ("usaspending", "nih_reporter", "nsf_awards")


def _path(path: str) -> Column:
    """A value of the parsed payload as text, lists and objects as JSON; null where it is missing or null."""
    return F.try_variant_get("_parsed", f"${path}" if path.startswith("[") else f"$.{path}", "string")


def _first(paths: list[str], record_id: Column | None = None) -> Column:
    def one(p: str) -> Column:
        if not p.startswith("="):
            return _path(p)
        if "{" not in p:
            return F.lit(p[1:])
        before, name, after = p[1:].replace("}", "{").split("{")
        return F.concat(F.lit(before), F.url_encode(record_id) if name == "url_id" else record_id, F.lit(after))

    return F.coalesce(*map(one, paths)) if paths else F.lit(None).cast("string")


def _array(value: Column) -> Column:
    """A JSON array's non-empty items, a non-blank text alone, or nothing."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(value.startswith("["), F.coalesce(items, strings(()))).when(F.trim(value) != "", F.array(F.trim(value))).otherwise(strings(()))


def _list(spec: list[str] | tuple[str, ...]) -> Column:
    return strings(spec) if isinstance(spec, tuple) else _array(_first(spec))


def _record(source: str) -> Column:
    """The canonical record of a row (payload, landed_at) of one source, whose id is in `_id`."""
    f = FIELDS[source]
    i, key = F.col("_id"), dedupe_key(F.lit(source), F.col("_id"))
    title, funding, status, opened = _first(f["title"]), _first(f["funding_type"]), _first(f["status"]), _first(f["open_date"])
    categories, eligibility = _list(f["categories"]), _list(f["eligibility"])
    if source == "sam_gov":
        funding = F.when(funding == "o", "procurement").otherwise(funding)
        status = F.when(status == "true", "active").otherwise(status)
        categories = F.transform(categories, lambda c: F.concat(F.lit("NAICS: "), c))
    elif source == "sbir":
        funding = F.when(funding == "STTR", "cooperative_agreement").otherwise("grant")
        status = F.when((F.coalesce(_path("open_date"), F.lit("")) != "") & (F.coalesce(_path("close_date"), F.lit("")) != ""), "active")
    elif source == "ted_eu":
        names = F.from_json(title, "map<string,string>")
        named = F.coalesce(names["ENG"], names["MUL"], F.try_element_at(F.map_values(names), F.lit(1)), F.concat(F.lit("EU Procurement "), i))
        title = F.when(title.isNull(), F.concat(F.lit("EU Procurement Notice "), i)).when(title.startswith("{"), named).otherwise(title)
        opened = F.when(opened.startswith("20"), F.substring(opened, 1, 10))
    geography = F.array(_first(f["geography"])) if isinstance(f["geography"], list) else strings(f["geography"])
    return F.struct(
        record_id_hash(key).alias("id"),
        F.lit(source).alias("source"),
        i.alias("source_record_id"),
        F.lit("historical_intelligence" if source in _HISTORICAL else "active_opportunity").alias("classification"),
        title.alias("title"),
        F.substring(F.coalesce(_first(f["description"]), F.lit("")), 1, 600).alias("description"),
        _first(f["agency"]).alias("agency"),
        funding.alias("funding_type"),
        status.alias("status"),
        opened.alias("open_date"),
        _first(f["close_date"]).alias("close_date"),
        parse_amount(_first(f["min_award"])).alias("min_award"),
        parse_amount(_first(f["max_award"])).alias("max_award"),
        eligibility.alias("eligibility"),
        categories.alias("categories"),
        strings(()).alias("keywords"),
        geography.alias("geography"),
        _first(f["url"], i).alias("url"),
        F.col("payload").alias("raw_payload"),
        F.col("landed_at").alias("normalized_at"),
        key.alias("dedupe_key"),
    )


def normalize(landed: DataFrame, sources: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The canonical records of all known sources (or those named) from landed (source, payload, landed_at), in one pass; rows without an id are left out."""
    of = lambda each: reduce(lambda out, s: F.when(F.col("source") == s, each(s)).otherwise(out), reversed(sources), F.lit(None))
    rows = landed.withColumn("_parsed", F.try_parse_json("payload")).withColumn("_id", of(lambda s: _first(FIELDS[s]["id"]))).where(F.coalesce("_id", F.lit("")) != "")
    return rows.select(of(_record).alias("r")).select("r.*")


def normalize_source(landed: DataFrame, source: str) -> DataFrame:
    return normalize(landed, (source,))


def live_items(items: DataFrame) -> DataFrame:
    """Live API items (source_raw, id, title, description, agency, amount, deadline, url) as opportunities with the few fields they have."""
    from ..functions.text import parse_live_amount
    from .registry import source_key

    source, none = source_key(F.col("source_raw")), strings(())
    own = F.coalesce("id", F.sha2(F.concat_ws("|", "source_raw", "title", "description", "url"), 256))
    return items.select(
        F.concat_ws("_", source, own).alias("id"), source.alias("source"), "source_raw", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("agency", F.lit("")).alias("agency"),
        F.lit("grant").alias("funding_type"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("open_date"), F.col("deadline").alias("close_date"), F.lit(None).cast("long").alias("min_award"),
        parse_live_amount(F.col("amount")).alias("max_award"), none.alias("eligibility"), none.alias("categories"), none.alias("keywords"), none.alias("geography"), F.coalesce("url", F.lit("")).alias("url"),
    )
