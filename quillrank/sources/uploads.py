"""Records and profiles from uploaded JSON: one object or array a file, or one text a row, coerced to the scoring schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings


def _field(payload: Column, name: str) -> Column:
    """A field as text: strings as they are, other values as JSON; null if it is missing or null."""
    return F.get_json_object(payload, f"$.{name}")


def _array(payload: Column, name: str) -> Column:
    """A field that is an array, as strings without nulls; null for anything else."""
    value = _field(payload, name)
    items = F.from_json(F.when(value.startswith("["), value), "array<string>")
    return F.filter(items, lambda x: x.isNotNull())


def upload(spark: SparkSession, path: str) -> DataFrame:
    """The objects of uploaded JSON files, each an object or an array of objects, as one JSON text a row (payload)."""
    text = F.trim("value")
    each = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return spark.read.text(path, wholetext=True).select(F.explode(each).alias("payload")).where("payload is not null")


def fixture_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The organization profiles of fixture files; their id is the file's own, or a hash of the profile where it has none."""
    rows = upload(spark, path)
    return coerce_profile(rows, F.coalesce(_field(F.col("payload"), "id"), F.sha2("payload", 256)))


def coerce_opportunity(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored records (JSON) as opportunities. geography may be an array, JSON text of one, or plain text; other lists count only as arrays."""
    p = F.col(payload)
    get = lambda name, default=None: F.coalesce(_field(p, name), F.lit(default)) if default is not None else _field(p, name)
    place = _field(p, "geography")
    parsed = F.filter(F.from_json(F.when(place.startswith("["), place), "array<string>"), lambda x: x.isNotNull())
    geography = F.when(F.coalesce(place, F.lit("")) == "", strings(())).otherwise(F.coalesce(parsed, F.array(place)))
    amount = lambda name: _field(p, name).try_cast("double").cast("long")
    return rows.select(
        _field(p, "id").alias("id"), _field(p, "source").alias("source"), _field(p, "source").alias("source_raw"), get("title", "Untitled").alias("title"), get("description", "").alias("description"), get("agency", "").alias("agency"),
        get("funding_type", "grant").alias("funding_type"), get("status", "active").alias("status"), get("open_date").alias("open_date"), get("close_date").alias("close_date"), amount("min_award").alias("min_award"), amount("max_award").alias("max_award"),
        *[F.coalesce(_array(p, k), strings(())).alias(k) for k in ("eligibility", "categories", "keywords")], geography.alias("geography"), get("url", "").alias("url"),
    )


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("", "false", "0", "null", "NaN"), F.lit(False))


def coerce_profile(rows: DataFrame, uid: Column, payload: str = "payload") -> DataFrame:
    """Organization profiles (JSON) with defaults; a single value stands for a list of one, and what is no number counts as 0. A null payload gives the empty profile."""
    p = F.coalesce(F.col(payload), F.lit("{}"))

    def listed(name: str) -> Column:
        value = _field(p, name)
        return F.coalesce(_array(p, name), F.when(_truthy(value), F.array(value))).alias(name)

    number = lambda name: F.coalesce(F.nullif(_field(p, name).try_cast("double"), F.lit(float("nan"))), F.lit(0.0)).alias(name)
    lists = [F.coalesce(listed(k), strings(())).alias(k) for k in ("program_areas", "population_served", "geography", "keywords")]
    return rows.select(
        uid.alias("id"), F.coalesce(_field(p, "name"), _field(p, "org_name"), F.lit("My Organization")).alias("name"), F.coalesce(_field(p, "org_type"), F.lit("nonprofit")).alias("org_type"), F.coalesce(_field(p, "mission"), F.lit("")).alias("mission"),
        *lists[:3], number("annual_budget"), number("years_in_operation"), _truthy(_field(p, "has_501c3")).alias("has_501c3"), _truthy(_field(p, "is_small_business")).alias("is_small_business"), lists[3],
    )
