"""The source registry as a small table, and source names as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, display name, classification, pagination, page size, status in ranking.
SOURCES = (
    ("simpler_grants", "Simpler Grants", "active_opportunity", "page", 100, "active"),
    ("grants_gov", "Grants.gov Search", "active_opportunity", "offset", 100, "active"),
    ("sam_gov", "SAM.gov Opportunities", "active_opportunity", "offset", 100, "active"),
    ("sbir", "SBIR/STTR", "active_opportunity", "offset", 100, "active"),
    ("threesixtygiving", "360Giving / UKRI", "active_opportunity", "offset", 100, "active"),
    ("california_grants", "California Grants Portal", "active_opportunity", "offset", 100, "active"),
    ("world_bank", "World Bank Procurement", "active_opportunity", "offset", 100, "active"),
    ("ted_eu", "TED EU", "active_opportunity", "page", 50, "active"),
    ("usaspending", "USASpending", "historical_intelligence", "cursor", 100, "excluded"),
    ("nih_reporter", "NIH RePORTER", "historical_intelligence", "offset", 500, "excluded"),
    ("nsf_awards", "NSF Awards", "historical_intelligence", "offset", 25, "excluded"),
)
KEYS = tuple(s[0] for s in SOURCES)
ACTIVE = tuple(s[0] for s in SOURCES if s[5] == "active")
#: Names that differ from their key by more than case and punctuation.
ALIASES = {
    "grantsgov": "grants_gov",
    "samgov": "sam_gov",
    "SBIR/STTR": "sbir",
    "SBIR (via USASpending)": "sbir",
    "360Giving": "threesixtygiving",
    "360Giving / UKRI": "threesixtygiving",
    "California Grants (via USASpending)": "california_grants",
}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, name string, classification string, pagination string, page_size int, status string")


def source_key(raw: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The registry key of a source name: an alias, or the name in lower case with _ for other characters."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw), F.regexp_replace(F.lower(raw), "[^a-z0-9]", "_"))


def is_active(raw: Column) -> Column:
    return F.coalesce(source_key(raw).isin(*ACTIVE), F.lit(False))


def split_active(opps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The opportunities of sources that take part in ranking, and the others."""
    return opps.where(is_active(F.col("source"))), opps.where(~is_active(F.col("source")))
