"""What is shown or handed out of scored rows: searches, tabs, sorts, counts, one common shape for all scorers, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round

#: Sort keys of the audit listing.
SORT_KEYS = {"total": "total", "mission": "mission_topic_fit", "elig": "eligibility_fit", "geo": "geography_fit", "funding": "funding_size_fit", "maturity": "maturity_fit"}
RAW_HEADERS = ("Rank", "Title", "Source", "Agency", "Total", "Mission(60)", "Eligibility(20)", "Geo(10)", "Funding(5)", "Maturity(5)", "Eligible", "URL")
HEADERS = ("Rank", "Score", "Confidence", "Title", "Source", "Agency", "Deadline", "MaxAward", "URL", "Eligible", "EligibilityReason", "Reasons", "Risks")
PRIORITIES = ("high", "medium", "low")


def audit_search(scored: DataFrame, source: str | None = None, text: str = "") -> DataFrame:
    """Rows of one source (or all) whose title or agency holds the text, ignoring case."""
    out = scored.where(F.col("source") == source) if source else scored
    low = text.strip().lower()
    return out.where(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower(F.coalesce("agency", F.lit(""))), F.lit(text.lower()))) if low else out


def verbose_search(rows: DataFrame, text: str = "") -> DataFrame:
    """Rows whose title or source holds the text, ignoring case."""
    return rows.where(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("source"), F.lit(text.lower()))) if text.strip() else rows


def audit_order(key: str = "total", direction: str = "desc") -> list[Column]:
    """The listing's order by one of SORT_KEYS. As in the listing it serves, `desc` puts the smallest values first and `asc` the largest."""
    column = F.col(SORT_KEYS.get(key, "maturity_fit"))
    return [column.asc() if direction == "desc" else column.desc(), F.asc("ord")]


def with_status(results: DataFrame, statuses: DataFrame, as_of: Column, close: Column) -> DataFrame:
    """Results (org_id, id, ...) with the user's status of each opportunity (opp_id, status), in place of any column of that name, and whether it is expired."""
    found = results.drop("status").join(statuses.select(F.col("opp_id").alias("id"), "status"), "id", "left")
    return found.withColumn("expired", F.coalesce(close < as_of, F.lit(False)))


def in_tab(tab: str) -> Column:
    """Whether a row of `with_status` belongs to a tab: saved, applied, inactive, or all (what is not expired)."""
    if tab == "inactive":
        return F.col("expired")
    return ~F.col("expired") & (F.lit(True) if tab == "all" else F.coalesce(F.col("status") == tab, F.lit(False)))


def tab_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(in_tab(t)).alias(t if t != "all" else "all_open") for t in ("all", "saved", "applied", "inactive")])


def playground_stats(results: DataFrame, by: str = "org_id", score: str = "total") -> DataFrame:
    """Per organization: results, eligible ones, those from 70 and from 50, mean (rounded half up) and best score."""
    s = F.col(score)
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_results"), F.count_if("passes_eligibility").alias("eligible"), F.count_if(s >= 70).alias("above70"), F.count_if(s >= 50).alias("above50"), js_round(F.avg(s)).cast("long").alias("avg_score"), F.max(s).alias("top_score")
    )


def flag_counts(compared: DataFrame, flags: tuple[str, ...] = ("rose", "fell", "new", "stable")) -> DataFrame:
    return compared.groupBy("org_id").agg(*[F.count_if(F.col("flag") == f).alias(f) for f in flags])


def comparison_order(first: str = "rank_1", second: str = "rank_2") -> list[Column]:
    """By the second list's rank, unranked rows last, then by the first list's."""
    return [F.coalesce(second, F.lit(999)).asc(), F.coalesce(first, F.lit(999)).asc(), F.asc("opp_id")]


def priority_order() -> list[Column]:
    place = F.lit(len(PRIORITIES))
    for i, p in enumerate(PRIORITIES):
        place = F.when(F.col("priority") == p, i).otherwise(place)
    return [place.asc(), F.asc("category")]


def most_frequent(counts: DataFrame, n: str = "n", most: int = 8, *ties: str) -> DataFrame:
    return counts.orderBy(F.desc(n), *ties).limit(most)


def run_metrics(ranked: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row over the ranked lists (org_id, source, total, rank) of a test run with these profiles."""
    best = ranked.groupBy("org_id").agg(F.max("total").alias("best"))
    heads = profiles.select(F.col("id").alias("org_id")).join(best, "org_id", "left").agg(
        F.count(F.lit(1)).alias("profiles"), F.count("best").alias("with_matches"), F.count_if(F.col("best").isNull()).alias("no_match"), F.coalesce(js_round(F.avg("best")), F.lit(0)).cast("long").alias("avg_top"),
        F.count_if(F.col("best") >= 70).alias("excellent"), F.count_if(F.col("best") >= 55).alias("strong"),
    )
    s = F.col("total")
    bands = ranked.agg(
        F.countDistinct("source").alias("sources"), F.count_if(s >= 70).alias("from_70"), F.count_if((s >= 55) & (s < 70)).alias("from_55"), F.count_if((s >= 38) & (s < 55)).alias("from_38"), F.count_if((s >= 25) & (s < 38)).alias("from_25"), F.count_if(s < 25).alias("below_25")
    )
    return heads.crossJoin(F.broadcast(bands))  # one row each


def run_report(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per profile of a test run: scored and eligible rows, the five bands of all scores, and how many sources the ranked list covers."""
    s, ok = F.when(F.col("passes_eligibility"), F.col("total")).otherwise(0), F.col("passes_eligibility") & (F.col("total") > 0)
    bands = scored.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(ok).alias("eligible"), F.count_if(s >= 70).alias("from_70"), F.count_if((s >= 55) & (s < 70)).alias("from_55"), F.count_if((s >= 38) & (s < 55)).alias("from_38"), F.count_if((s >= 25) & (s < 38)).alias("from_25"), F.count_if(s < 25).alias("below_25")
    )
    cover = ranked.groupBy("org_id").agg(F.count(F.lit(1)).alias("listed"), F.countDistinct("source").alias("sources"), F.max("total").alias("best"))
    return bands.join(cover, "org_id", "left")


def unified(ranked: DataFrame, version: str, dimensions: tuple[str, ...]) -> DataFrame:
    """Any scorer's ranked rows in one shape: version, org_id, id, rank, score, confidence, eligible and a map of the dimensions.

    The confidence is the scorer's own where it has one in its shape (V4), else by its version's limits.
    """
    s = F.col("total")
    high = F.when(s >= 70, "excellent")
    by = high.when(s >= 55, "strong").when(s >= 38, "moderate") if version in ("v3", "v4") else high.when(s >= 50, "strong").when(s >= 30, "moderate")
    confidence = F.col("confidence") if version == "v4" else by.otherwise("weak")
    eligible = F.lit(True) if version == "v5" else F.col("passes_eligibility")
    pairs = F.map_from_arrays(F.array(*[F.lit(d) for d in dimensions]), F.array(*[F.col(d).cast("long") for d in dimensions]))
    return ranked.select(F.lit(version).alias("version"), "org_id", "id", F.col("rank").cast("long").alias("rank"), s.cast("long").alias("score"), confidence.alias("confidence"), eligible.alias("eligible"), pairs.alias("dimensions"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(rank: Column, score: Column, confidence: Column, opp: dict[str, Column], eligible: Column, why: Column, reasons: Column, risks: Column) -> Column:
    """A line of the export with HEADERS: texts quoted, quotes doubled, lists joined by ` | `."""
    plain = [rank.cast("string"), score.cast("string"), confidence]
    texts = [_quoted(opp[k]) for k in ("title", "source", "agency", "close_date", "max_award", "url")]
    return F.concat_ws(",", *plain, *texts, F.when(eligible, "Yes").otherwise("No"), _quoted(why), _quoted(F.array_join(reasons, " | ")), _quoted(F.array_join(risks, " | ")))


def raw_csv_line(rank: Column) -> Column:
    """A line of the raw export with RAW_HEADERS: title and agency quoted, quotes in them turned to apostrophes."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    values = [F.col(SORT_KEYS[k]).cast("string") for k in ("total", "mission", "elig", "geo", "funding", "maturity")]
    return F.concat_ws(",", rank.cast("string"), text("title"), "source", text("agency"), *values, F.when(F.col("passes_eligibility"), "yes").otherwise("no"), F.coalesce("url", F.lit("")))


def json_line(*columns: str) -> Column:
    """A row of the JSON export."""
    return F.to_json(F.struct(*columns))


def shown_places(places: Column) -> Column:
    """The first two places, or a dash without any."""
    return F.when(F.size(places) > 0, F.array_join(F.slice(places, 1, 2), ", ")).otherwise("—")


def shown_amount(amount: Column) -> Column:
    """An amount with a dollar sign and thousands separators; null for none and for 0."""
    return F.when(amount != 0, F.concat(F.lit("$"), F.format_number(amount, 0)))
