"""All fields of all sources' records, from payloads with the first fields, with the fallbacks, and with nothing but an id; the values are written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillrank.sources import landed

NAMES = ("source_record_id", "classification", "title", "description", "agency", "funding_type", "status", "open_date", "close_date", "min_award", "max_award", "eligibility", "categories", "keywords", "geography", "url")
US, LIVE, PAST = ["United States"], "active_opportunity", "historical_intelligence"
CASES = [
    ("simpler_grants", {"opportunity_id": 7, "legacy_opportunity_id": 1, "opportunity_title": "T", "agency_name": "A", "top_level_agency_name": "B", "opportunity_status": "posted", "category": "c", "summary": {"summary_description": "d" * 700, "post_date": "p", "close_date": "q", "forecasted_close_date": "r", "award_floor": 5, "award_ceiling": "1,000", "estimated_total_program_funding": 3, "applicant_types": ["x", "", None, "y"]}},
     ("7", LIVE, "T", "d" * 600, "A", "grant", "posted", "p", "q", 5, 1000, ["x", "y"], ["c"], [], US, "https://simpler.grants.gov/opportunity/7")),
    ("simpler_grants", {"legacy_opportunity_id": "L", "top_level_agency_name": "B", "category": ["c1", "c2"], "summary": {"forecasted_close_date": "r", "estimated_total_program_funding": "$2.5"}},
     ("L", LIVE, "Untitled", "", "B", "grant", None, None, "r", None, 3, [], ["c1", "c2"], [], US, "https://simpler.grants.gov/opportunity/L")),
    ("grants_gov", {"id": "1", "title": "T", "synopsis": "s", "description": "d", "agencyName": "A", "fundingCategory": "f", "oppStatus": "o", "openDate": "p", "closeDate": "q", "deadlineDate": "r", "awardFloor": "10", "awardCeiling": "20", "eligibility": ["e"]},
     ("1", LIVE, "T", "s", "A", "f", "o", "p", "q", 10, 20, ["e"], ["f"], [], US, "https://www.grants.gov/search-results-detail/1")),
    ("grants_gov", {"oppNum": "N", "oppTitle": "U", "description": "d", "agency": "B", "deadlineDate": "r"}, ("N", LIVE, "U", "d", "B", "grant", None, None, "r", None, None, [], [], [], US, "https://www.grants.gov/search-results-detail/N")),
    ("sam_gov", {"noticeId": "1", "title": "T", "description": "d", "fullParentPathName": "A", "type": "o", "active": True, "postedDate": "p", "responseDeadLine": "q", "baseAndAllOptionsValue": "9", "typeOfSetAside": "SBA", "naicsCode": "54", "uiLink": "u"},
     ("1", LIVE, "T", "d", "A", "procurement", "active", "p", "q", None, 9, ["SBA"], ["NAICS: 54"], [], US, "u")),
    ("sam_gov", {"solicitationNumber": "S", "synopsis": "y", "organizationHierarchy": [{"name": "B"}, {"name": "C"}], "type": "k", "active": "No", "archiveDate": "r"}, ("S", LIVE, "Untitled", "y", "B", "k", "No", None, "r", None, None, [], [], [], US, "https://sam.gov/opp/S/view")),
    ("sbir", {"solicitation_id": "1", "solicitation_title": "T", "program_description": "d", "agency": "A", "program": "STTR", "open_date": "p", "close_date": "q", "award_ceiling": 8, "program_solicitation_agency_interest_area": "i", "solicitation_link": "u"},
     ("1", LIVE, "T", "d", "A", "cooperative_agreement", "active", "p", "q", None, 8, ["small_business"], ["i"], [], US, "u")),
    ("sbir", {"program_solicitation_id": "2", "program_title": "U", "abstract": "b", "branch": "B", "program": "SBIR", "release_date": "p", "submission_deadline": "q", "program_year_1_funding": "7", "technology_topic": ["t"]},
     ("2", LIVE, "U", "b", "B", "grant", None, "p", "q", None, 7, ["small_business"], ["t"], [], US, "https://www.sbir.gov/solicitations")),
    ("sbir", {"solicitation_number": "3"}, ("3", LIVE, "Untitled", "", None, "grant", None, None, None, None, None, ["small_business"], [], [], US, "https://www.sbir.gov/solicitations")),
    ("threesixtygiving", {"Identifier": "1", "Title": "T", "Description": "d", "Funding Org:Name": "A", "Award Date": "p", "Amount Applied For": 4, "Amount Awarded": 6, "Grant Programme:Title": "g", "URL": "u"},
     ("1", LIVE, "T", "d", "A", "grant", "active", "p", None, 4, 6, [], ["g"], [], ["United Kingdom"], "u")),
    ("threesixtygiving", {"id": "2", "title": "t", "description": "e", "fundingOrganization": {"name": "B"}}, ("2", LIVE, "t", "e", "B", "grant", "active", None, None, None, None, [], [], [], ["United Kingdom"], "https://grantsnav.threesixtygiving.org/")),
    ("california_grants", {"id": "1", "title": "T", "description": "d", "agency": "A", "status": "s", "published_date": "p", "deadline": "q", "funding_minimum": 1, "funding_maximum": 2, "applicant_type": ["a"], "category": "c", "url": "u"},
     ("1", LIVE, "T", "d", "A", "grant", "s", "p", "q", 1, 2, ["a"], ["c"], [], ["California", "United States"], "u")),
    ("california_grants", {"grant_id": "2", "grant_title": "U", "purpose": "e", "administering_agency": "B", "due_date": "q", "min_award": 3, "max_award": 4, "eligibility": "b", "funding_area": ["f"], "link": "v"},
     ("2", LIVE, "U", "e", "B", "grant", "active", None, "q", 3, 4, ["b"], ["f"], [], ["California", "United States"], "v")),
    ("world_bank", {"id": "P1", "title": "T", "project_abstract": "d", "borrower": "A", "status": "s", "boardapprovaldate": "p", "closingdate": "q", "totalamt": "1,500,000", "theme_namecode": ["m"], "countryname": "Kenya", "url": "u"},
     ("P1", LIVE, "T", "d", "A", "procurement", "s", "p", "q", None, 1500000, [], ["m"], [], ["Kenya"], "u")),
    ("world_bank", {"id": "P2", "project_name": "U", "description": "e", "ibrd_country": "B", "approvaldate": "p", "lendprojectcost": 12, "sector_namecode": "n"},
     ("P2", LIVE, "U", "e", "B", "procurement", "active", "p", None, None, 12, [], ["n"], [], ["International"], "https://projects.worldbank.org/en/projects-operations/project-detail/P2")),
    ("ted_eu", {"publication-number": "1-2026", "BT-21-Procedure": {"DEU": "D", "ENG": "E"}, "BT-02-notice": "d", "buyer": [{"officialName": "A"}], "BT-05(a)-notice": "2026-03-01+01:00", "deadline": "q", "totalValueOfBusiness": 5, "mainCpvCode": {"codeValue": "45"}, "isoCountry": "DE", "links": {"pdf": {"ENG": "u"}, "html": {"ENG": "v"}}},
     ("1-2026", LIVE, "E", "d", "A", "procurement", "active", "2026-03-01", "q", None, 5, [], ["45"], [], ["DE"], "u")),
    ("ted_eu", {"noticeNumber": "2", "BT-21-Procedure": {"FRA": "F"}, "shortDescription": [{"value": "w"}], "CA": "B", "publicationDate": "01/03/2026", "DT": "q", "contractValue": 6, "links": {"html": {"ENG": "v"}}},
     ("2", LIVE, "F", "w", "B", "procurement", "active", None, "q", None, 6, [], [], [], ["European Union"], "v")),
    ("ted_eu", {"ND": "3", "description": "x"}, ("3", LIVE, "EU Procurement Notice 3", "x", None, "procurement", "active", None, None, None, None, [], [], [], ["European Union"], "https://ted.europa.eu/en/notice/3")),
    ("ted_eu", {"ND": "4", "BT-21-Procedure": "plain"}, ("4", LIVE, "plain", "", None, "procurement", "active", None, None, None, None, [], [], [], ["European Union"], "https://ted.europa.eu/en/notice/4")),
    ("usaspending", {"Award ID": "A/1 x", "Recipient Name": "R", "Description": "d", "Awarding Agency": "A", "Award Type": "k", "Start Date": "p", "End Date": "q", "Award Amount": 1234.5},
     ("A/1 x", PAST, "R", "d", "A", "k", "archived", "p", "q", 1235, 1235, [], [], [], US, None)),
    ("usaspending", {"award_id": "2", "recipient_name": "S", "description": "e", "awarding_agency_name": "B"}, ("2", PAST, "S", "e", "B", "grant", "archived", None, None, None, None, [], [], [], US, "https://www.usaspending.gov/award/2")),
    ("nih_reporter", {"project_num": "5R01", "project_title": "T", "abstract_text": "d", "agency_code": "A", "project_start_date": "p", "project_end_date": "q", "award_amount": 99}, ("5R01", PAST, "T", "d", "A", "grant", "archived", "p", "q", None, 99, [], [], [], US, "https://reporter.nih.gov/search/5R01")),
    ("nih_reporter", {"project_num": "6", "organization": {"org_name": "B"}}, ("6", PAST, "Untitled Project", "", "B", "grant", "archived", None, None, None, None, [], [], [], US, "https://reporter.nih.gov/search/6")),
    ("nsf_awards", {"id": "1", "title": "T", "abstractText": "d", "startDate": "p", "expDate": "q", "fundsObligatedAmt": "77"}, ("1", PAST, "T", "d", "NSF", "grant", "archived", "p", "q", None, 77, [], [], [], US, "https://www.nsf.gov/awardsearch/showAward?AWD_ID=1")),
    ("nsf_awards", {"id": "2", "title": None, "fundsObligatedAmt": "none"}, ("2", PAST, "Untitled", "", "NSF", "grant", "archived", None, None, None, None, [], [], [], US, "https://www.nsf.gov/awardsearch/showAward?AWD_ID=2")),
]
LOST = [("nsf_awards", "{}"), ("nsf_awards", '{"id": ""}'), ("sam_gov", "not json"), ("sam_gov", None), ("elsewhere", '{"id": "1"}'), ("nih_reporter", '{"project_num": null}'), ("ted_eu", "[1]")]


def test_all_fields_of_all_sources(spark):
    rows = [(source, json.dumps(payload)) for source, payload, _ in CASES] + LOST
    got = landed.normalize(spark.createDataFrame(rows, "source string, payload string").withColumn("landed_at", F.lit("2026-04-01").cast("timestamp"))).collect()
    assert len(got) == len(CASES)
    made = {(r["source"], r["source_record_id"]): r for r in got}
    for source, payload, want in CASES:
        r = made[source, want[0]]
        assert {k: r[k] for k, v in zip(NAMES, want, strict=True) if v is not None or k != "url"} == {k: v for k, v in zip(NAMES, want, strict=True) if v is not None or k != "url"}, (source, payload)
        assert r["dedupe_key"] == f"{source}::{want[0]}" and json.loads(r["raw_payload"]) == payload
    assert made["usaspending", "A/1 x"]["url"].startswith("https://www.usaspending.gov/award/A%2F1")


@pytest.mark.parametrize("source", sorted(landed.FIELDS))
def test_one_source_alone(spark, source):
    mine = [(s, json.dumps(p)) for s, p, _ in CASES]
    table = spark.createDataFrame(mine, "source string, payload string").withColumn("landed_at", F.lit("2026-04-01").cast("timestamp"))
    assert {r["source_record_id"] for r in landed.normalize_source(table, source).collect()} == {w[0] for s, _, w in CASES if s == source}
