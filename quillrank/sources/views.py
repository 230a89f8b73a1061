"""Opportunities, organizations, labels and events derived from the driver's tables.

The driver's tables hold no funding data. Titles, keywords and missions are put together from fixed phrases by arithmetic on the key, so that the
topical operators have something to find; descriptions end with the whole text of the document. See the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings
from .registry import KEYS

PHRASES = (
    "maternal health", "workforce development", "job training", "affordable housing", "food security", "climate change", "clean energy", "mental health",
    "youth mentoring", "early childhood education", "small business growth", "digital innovation", "community health workers", "rural broadband access", "veterans services",
    "arts education", "disaster relief", "substance abuse treatment", "senior nutrition", "stem tutoring", "homelessness prevention", "refugee resettlement", "water infrastructure",
)
FRAMES = ("Initiative FY2026", "Program Support Services", "Community Development Grant", "Research and Evaluation Study", "Innovation Challenge", "Capacity Building Cooperative", "Procurement Notice")
NOTES = ("Applicants need a track record.", "Prior federal experience is preferred.", "Open to new applicants.", "Funding is highly competitive.", "", "Partners must be established locally.")
ELIGIBILITY = ((), ("nonprofit",), ("small_business",), ("nonprofit", "small_business"), ("501c3",), ("university", "nonprofit"), ("government",), ("all",))
FUNDING = ("grant", "contract", "procurement", "cooperative_agreement")
ORG_TYPES = ("nonprofit", "small_business", "university", "government", "nonprofit", "other")
GEOGRAPHY = {"en": ("United States",), "fr": ("European Union",), "de": ("International",)}
PLACES = {"AMERICA": ("Ohio", "United States"), "EUROPE": ("European Union",), "ASIA": ("global",)}


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(strings(values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opportunity per document, in the scoring schema; `ord` gives the arrival order."""
    d, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    eligibility = F.element_at(F.array(*[strings(e) for e in ELIGIBILITY]), (F.pmod(n, F.lit(8)) + 1).cast("int"))
    geography = strings(())
    for lang, places in GEOGRAPHY.items():
        geography = F.when(F.col("lang") == lang, strings(places)).otherwise(geography)
    day = lambda start, k, m: F.date_format(F.date_add(F.lit(start).cast("date"), F.pmod(n * k, F.lit(m)).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.concat(F.lit("doc_"), n).alias("id"),
        n.alias("ord"),
        F.element_at(strings(KEYS), (F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(11)) + 1).cast("int")).alias("source"),
        F.col("source").alias("source_raw"),
        F.concat_ws(" ", _pick(PHRASES, n), _pick(FRAMES, n)).alias("title"),
        F.concat_ws(" ", _pick(PHRASES, n * 7 + 3), _pick(NOTES, n), "text").alias("description"),
        F.concat(F.lit("Agency "), F.pmod(n, F.lit(17))).alias("agency"),
        _pick(FUNDING, n).alias("funding_type"),
        F.lit("active").alias("status"),
        F.when(n % 10 != 9, day("2026-01-01", 1, 120)).alias("open_date"),
        F.when(n % 13 == 12, None).when(n % 11 == 10, "rolling").otherwise(day("2026-03-01", 3, 180)).alias("close_date"),
        F.when(n % 6 != 0, F.col("n_chars") * 10).alias("min_award"),
        F.when(n % 5 != 0, F.col("n_chars") * 100).alias("max_award"),
        eligibility.alias("eligibility"),
        F.array(_pick(PHRASES, n * 3 + 1)).alias("categories"),
        F.array(_pick(PHRASES, n), _pick(PHRASES, n * 5 + 2)).alias("keywords"),
        geography.alias("geography"),
        F.concat(F.lit("https://example.org/opportunities/"), n).alias("url"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One organization per nation: 25 at any scale, the stated set of profiles that opportunities are scored for."""
    k = F.col("n_nationkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    geography = strings(("Kenya",))
    for region, places in PLACES.items():
        geography = F.when(F.col("r_name") == region, strings(places)).otherwise(geography)
    kind = _pick(ORG_TYPES, k)
    return rows.select(
        F.concat(F.lit("org_"), k).alias("id"),
        F.col("n_name").alias("name"),
        kind.alias("org_type"),
        F.concat(F.lit("We advance "), _pick(PHRASES, k), F.lit(" and "), _pick(PHRASES, k * 2 + 5), F.lit(" for all our neighbours.")).alias("mission"),
        F.array(_pick(PHRASES, k), _pick(PHRASES, k + 9)).alias("program_areas"),
        F.array(_pick(("youth", "veterans", "families", "seniors"), k)).alias("population_served"),
        geography.alias("geography"),
        ((k + 1) * 75000).cast("double").alias("annual_budget"),
        (k % 8).cast("double").alias("years_in_operation"),
        ((kind == "nonprofit") & (k % 3 != 0)).alias("has_501c3"),
        (kind == "small_business").alias("is_small_business"),
        F.array(_pick(PHRASES, k * 4 + 1), _pick(PHRASES, k)).alias("keywords"),
    )


def evaluation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of opportunities for one organization each: (opp_id, org_id, eval_label, feedback)."""
    n = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.concat(F.lit("doc_"), n).alias("opp_id"),
        F.concat(F.lit("org_"), n % 25).alias("org_id"),
        F.when(F.col("quality") == 1, F.when(n % 2 == 0, "strong_fit").otherwise("possible_fit")).otherwise(F.when(n % 2 == 0, "weak_fit").otherwise("not_a_fit")).alias("eval_label"),
        F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").when(n % 3 == 0, "unsure").otherwise("weak").alias("feedback"),
    )
