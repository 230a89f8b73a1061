"""Queries over landed API pages: written from documents, read back through the data source, normalized."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports, reports, store
from ..sources import landed, landed_pages, staging
from ..streaming import events
from . import oracle, report_queries
from .queries import _events as event_rows

#: An item of each source with its own field names; N stands for the document's number, D for a date and S for a status.
ITEMS = {
    "simpler_grants": {"opportunity_id": "N", "opportunity_title": "Title N", "opportunity_status": "S", "summary": {"post_date": "D", "award_ceiling": "N00"}},
    "grants_gov": {"id": "N", "title": "Title N", "oppStatus": "S", "openDate": "D", "awardCeiling": "N00"},
    "sam_gov": {"noticeId": "N", "title": "Title N", "active": "S", "postedDate": "D", "baseAndAllOptionsValue": "N00"},
    "sbir": {"solicitation_id": "N", "solicitation_title": "Title N", "open_date": "D", "award_ceiling": "N00"},
    "threesixtygiving": {"Identifier": "N", "Title": "Title N", "Award Date": "D", "Amount Awarded": "N00"},
    "california_grants": {"id": "N", "title": "Title N", "status": "S", "published_date": "D", "funding_maximum": "N00"},
    "world_bank": {"id": "N", "title": "Title N", "status": "S", "boardapprovaldate": "D", "totalamt": "N00"},
    "ted_eu": {"publication-number": "N", "BT-21-Procedure": "Title N", "publicationDate": "D", "totalValueOfBusiness": "N00"},
    "usaspending": {"Award ID": "N", "Recipient Name": "Title N", "Start Date": "D", "Award Amount": "N00"},
    "nih_reporter": {"project_num": "N", "project_title": "Title N", "project_start_date": "D", "award_amount": "N00"},
    "nsf_awards": {"id": "N", "title": "Title N", "startDate": "D", "fundsObligatedAmt": "N00"},
}
PAGE = 100
SINCE = "2026-02-15"


def landed_items(spark: SparkSession, sf: str) -> DataFrame:
    """source, page and payload: one item a document, dealt to the sources in turn."""
    n, k = F.col("doc_id"), len(ITEMS)
    name = F.get(F.array(*[F.lit(s) for s in ITEMS]), F.pmod(n, F.lit(k)).cast("int"))
    text = F.get(F.array(*[F.lit(json.dumps(i)) for i in ITEMS.values()]), F.pmod(n, F.lit(k)).cast("int"))
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(n * 7, F.lit(90)).cast("int")), "yyyy-MM-dd")
    for mark, value in (('"N"', F.concat(F.lit('"'), n, F.lit('"'))), ("Title N", F.concat(F.lit("Title "), n)), ("N00", F.concat(n, F.lit("00"))), ('"D"', F.concat(F.lit('"'), day, F.lit('"'))), ('"S"', F.when(n % 2 == 0, '"posted"').otherwise('"forecasted"'))):
        text = F.replace(text, F.lit(mark), value)
    return spark.read.parquet(f"{sf}/documents.parquet").select(name.alias("source"), F.floor(n / (k * PAGE)).alias("page"), text.alias("payload"))


def land(spark: SparkSession, sf: str) -> str:
    """The folder that the pages of all documents were written to."""
    path = staging.own_folder(spark, "landing")
    listed = staging.staged(landed_pages.land_pages(landed_items(spark, sf), path, "2026-04-01T00:00:00+00:00"), "pages")
    landed_pages.list_pages(spark, listed, path)
    return path


def landed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical records of what was posted since a date, for all sources but two; the reader leaves out what the filters rule out."""
    rows = landed_pages.read_pages(spark, land(spark, sf))
    rows = rows.where((F.col("posted") >= SINCE) & F.col("source").isin(*[s for s in ITEMS if s not in ("sbir", "nsf_awards")]))
    return landed.normalize(rows.select("source", "payload", "landed_at")).select("source", "source_record_id", "title", "open_date", "max_award")


def landed_page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each page, cursor sources included."""
    rows = landed_pages.read_pages(spark, land(spark, sf), pages=4)
    return rows.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "posted").alias("posted"))


def updated_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the nations after three rounds of updates: the second has seen the first's version, the third an outdated one."""
    n = F.col("n_nationkey").cast("long")
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    profile = lambda text: F.struct(F.concat(F.col("n_name"), F.lit(text)).alias("name"), F.array(F.lit("a"), F.lit(text)).alias("areas"))
    now = nations.select(n.alias("id"), F.lit(1).cast("long").alias("version"), profile("").alias("profile"))
    change = lambda text, seen, at: nations.select(n.alias("id"), F.lit(seen).cast("long").alias("seen"), profile(text).alias("profile"), F.lit(at).alias("at"))
    first = change(" one", 1, 1).where(n % 2 == 0).unionByName(change(" lost", 1, 2).where(n % 4 == 0))
    now, gone = store.update_profiles(now, first)
    now, late = store.update_profiles(now, change(" two", 2, 3).where(n % 3 == 0))
    lost = gone.unionByName(late).groupBy("id").agg(F.count(F.lit(1)).alias("refused"))
    return now.join(lost, "id", "left").select("id", "version", "profile.name", F.array_join("profile.areas", ",").alias("areas"), F.coalesce("refused", F.lit(0)).alias("refused"))


def _fed(spark: SparkSession, sf: str) -> DataFrame:
    """The events as they arrive: every 50th two hours late, every tenth twice."""
    rows = event_rows(spark, sf).withColumn("received_at", F.col("ts") + F.when(F.col("event_id") % 50 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 1 minute")))
    return rows.unionByName(rows.where("event_id % 10 = 0").withColumn("received_at", F.col("received_at") + F.expr("interval 5 minutes")))


def accepted_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.accepted(_fed(spark, sf)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("last"))


def refused_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.refused(_fed(spark, sf)).groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def exported_files(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the exports' files, read back: comma-separated, raw, and JSON."""
    path, out = staging.own_folder(spark, "exports"), []
    rows = staging.staged(report_queries.listed(spark, sf).drop("tokens", "topics"), "listed")  # a few rows for each organization: the writers read them several times
    for name, lines, header in (("csv", report_queries.csv_lines(rows), reports.HEADERS), ("raw", report_queries.raw_csv_lines(rows), reports.RAW_HEADERS)):
        exports.write_csv(lines, header, f"{path}/{name}")
    exports.write_json(report_queries.json_lines(rows), {"version": F.lit("v1")}, f"{path}/json")
    for name in ("csv", "raw", "json"):
        out.append(exports.read_lines(spark, f"{path}/{name}").select(F.lit(name).alias("kind"), "org_id", "line"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def queries() -> dict:
    return {q.__name__: q for q in (landed_scan, landed_page_sizes, updated_profiles, accepted_events, refused_events, exported_files)}


def oracle_sql() -> dict[str, str]:
    names = "[" + ", ".join(f"'{s}'" for s in ITEMS) + "]"
    stated = ", ".join(f"'{s}'" for s, i in ITEMS.items() if '"S"' in json.dumps(i))
    items = f"with i as (select doc_id as n, {names}[1 + doc_id % {len(ITEMS)}] as source, doc_id // {len(ITEMS) * PAGE} as page, strftime(date '2026-01-01' + (doc_id * 7 % 90)::int, '%Y-%m-%d') as day from documents) "
    fed = "with " + oracle._EVENTS + """, fed as (
      select *, ts + case when event_id % 50 = 0 then interval 2 hours else interval 1 minute end as received_at from ev
      union all select *, ts + case when event_id % 50 = 0 then interval 2 hours else interval 1 minute end + interval 5 minutes from ev where event_id % 10 = 0),
    why as (select *, case when event_type = 'error' or event_type is null then 'unknown type' when source_user_id is null then 'no user' when ts + interval 1 hour < received_at then 'late' end as reason from fed) """
    made = report_queries.oracle_sql()
    lines = lambda name: f"(select * from ({made[name]}))"
    return {
        "updated_profiles": """
            select n_nationkey::bigint as id, case when n_nationkey % 2 = 0 then case when n_nationkey % 3 = 0 then 3 else 2 end else 1 end::bigint as version,
              n_name || case when n_nationkey % 6 = 0 then ' two' when n_nationkey % 2 = 0 then ' one' else '' end as name, 'a,' || case when n_nationkey % 6 = 0 then ' two' when n_nationkey % 2 = 0 then ' one' else '' end as areas,
              ((n_nationkey % 4 = 0)::int + (n_nationkey % 3 = 0 and n_nationkey % 2 <> 0)::int)::bigint as refused from nation""",
        "accepted_events": fed + "select event_type, count(*) as n, max(received_at) as last from (select * from why where reason is null qualify row_number() over (partition by event_id order by received_at, ts) = 1) group by event_type",
        "refused_events": fed + "select event_type, reason, count(*) as n from why where reason is not null group by all",
        "exported_files": "with c as " + lines("export_csv") + ", w as " + lines("export_raw_csv") + ", j as " + lines("export_json") + f""", m as (select org_id, max(rank) as k, count(*) as n from j group by org_id)
            select 'csv' as kind, org_id, line from c union all select distinct 'csv', org_id, '{",".join(reports.HEADERS)}' from c
            union all select 'raw', org_id, line from w union all select distinct 'raw', org_id, '{",".join(reports.RAW_HEADERS)}' from w
            union all select 'json', org_id, line || case when rank = k then ']}}' else ',' end from j join m using (org_id)
            union all select 'json', org_id, '{{"org_id":"' || org_id || '","version":"v1","count":' || n || ',"results":[' from m""",
        "landed_scan": items + f"select source, n::varchar as source_record_id, 'Title ' || n as title, day as open_date, nullif(n * 100, 0) as max_award from i where day >= '{SINCE}' and source not in ('sbir', 'nsf_awards')",
        "landed_page_sizes": items + f"select source, page, count(*) as n, count(*) filter (n % 2 = 0 and source in ({stated})) as posted from i group by all",
    }
