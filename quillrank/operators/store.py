"""The canonical record store: keyed upsert, deletes, run log, listings and statistics.

A store is a DataFrame in and a DataFrame out; writing it to a new place and switching over is the caller's step, since no plan may read and overwrite
one path. Partition the written store by `source`, so that listings and deletes by source prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an update of an existing record refreshes; all other columns keep what the first insert gave them.
REFRESHED = ("title", "description", "agency", "status", "close_date", "min_award", "max_award", "url", "raw_payload", "normalized_at")
RUN_REFRESHED = ("status", "total_fetched", "total_inserted", "total_updated", "total_skipped", "total_errors", "last_page", "stop_reason", "error_message", "completed_at")
LISTED = ("id", "source", "source_record_id", "classification", "title", "agency", "funding_type", "status", "open_date", "close_date", "min_award", "max_award", "geography", "url", "normalized_at", "dedupe_key")


def upsert(target: DataFrame, staged: DataFrame, key: str, order: Column, refreshed: tuple[str, ...] = REFRESHED, flags: bool = False) -> DataFrame:
    """target after all staged rows were inserted or, where the key exists, had `refreshed` updated, one by one in `order`.

    Of a new key's rows, the first gives the columns that updates leave alone and the last gives the refreshed ones. Staged rows without a key
    are left out. Both sides are reduced to one row a key before the join, so a hot key costs no more than its rows. With `flags`, `_old` tells whether the
    key was there before and `_n` how many staged rows it had; null where not and where none.
    """
    names = target.columns
    rows = staged.where(F.col(key).isNotNull()).withColumn("_o", order)
    row = F.struct("_o", *names)
    edge = rows.groupBy(key).agg(F.min_by(row, "_o").alias("first"), F.max_by(row, "_o").alias("last"), F.count(F.lit(1)).alias("_n"))
    joined = target.withColumn("_old", F.lit(True)).join(edge, key, "full_outer")
    pick = lambda c: F.when(F.col("last").isNull(), F.col(c)).otherwise(F.col(f"last.{c}")) if c in refreshed else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"first.{c}"))
    return joined.select(*[F.col(key) if c == key else pick(c).alias(c) for c in names], *["_old", "_n"] * flags)


def update_profiles(profiles: DataFrame, updates: DataFrame, key: str = "id", order: str = "at") -> tuple[DataFrame, DataFrame]:
    """Whole profiles replaced where an update names the version it has seen; returns the profiles after it and the updates that were refused, with the reason.

    `profiles` has key, version and profile (of any type, as a whole); `updates` has key, seen, profile and `order`. Of the updates that have seen the current version the first wins and raises the
    version by one; the others would undo it and are refused as `stale`, like those that have seen another version. An update of an unknown or null key is refused as `unknown`. A null profile is a value
    like any other. Updates at the same `order` go by the version they have seen, then by their content.
    """
    w = Window.partitionBy(key).orderBy(order, "seen", F.xxhash64("profile"))
    met = updates.join(profiles.select(F.col(key), F.col("version").alias("_now")), key, "left").withColumn("_fits", F.coalesce(F.col("seen") == F.col("_now"), F.lit(False)))
    met = met.withColumn("_n", F.sum(F.col("_fits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wins = F.col("_fits") & (F.col("_n") == 1)
    won = met.where(wins).select(key, F.col("profile").alias("_profile"), F.lit(True).alias("_won"))
    after = profiles.join(won, key, "left").withColumns({"profile": F.when(F.col("_won"), F.col("_profile")).otherwise(F.col("profile")), "version": F.col("version") + F.when(F.col("_won"), 1).otherwise(0)})
    lost = met.where(~wins).withColumn("reason", F.when(F.col("_now").isNull(), "unknown").otherwise("stale"))
    return after.select(*profiles.columns), lost.select(*updates.columns, "reason")


def upsert_counts(target: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """One row: how many staged rows insert a new key, update one, or have none (errors)."""
    keys = staged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(target.select(key, F.lit(True).alias("old")), key, "left")
    new = F.col("old").isNull() & F.col(key).isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(
        total(F.when(new, 1).otherwise(0)).alias("inserted"),
        total(F.when(F.col(key).isNull(), 0).when(new, F.col("n") - 1).otherwise(F.col("n"))).alias("updated"),
        total(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)).alias("errors"),
    )


def delete_by_source(store: DataFrame, source: str) -> DataFrame:
    return store.where(~F.coalesce(F.col("source") == source, F.lit(False)))


def truncate(store: DataFrame) -> DataFrame:
    return store.limit(0)


def matching(store: DataFrame, source: str | None = None, classification: str | None = None, keyword: str | None = None) -> DataFrame:
    """The optional filters, all of which must hold; % and _ in the keyword are wildcards."""
    out = store.where(F.col("source") == source) if source else store
    out = out.where(F.col("classification") == classification) if classification else out
    return out.where(F.col("title").ilike(f"%{keyword}%")) if keyword else out


def listing(store: DataFrame, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    """A page of matching records, newest first."""
    rows = matching(store, **filters).select(*[c for c in LISTED if c in store.columns])
    return rows.orderBy(F.desc("normalized_at"), "id").offset(offset).limit(limit)


def count_by_source(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def statistics(store: DataFrame) -> DataFrame:
    """One row: all records, active and historical ones."""
    return store.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("classification") == "active_opportunity").alias("active"), F.count_if(F.col("classification") == "historical_intelligence").alias("historical"))


def pool_search(opps: DataFrame, keyword: str = "", source: str | None = None, funding_type: str | None = None) -> DataFrame:
    """Substring search over title, description and keywords, ignoring case."""
    out = opps.where(F.col("source") == source) if source else opps
    out = out.where(F.col("funding_type") == funding_type) if funding_type else out
    return out.where(F.contains(F.lower(F.concat_ws(" ", "title", "description", F.array_join("keywords", " "))), F.lit(keyword.lower())))


def latest_lines(log: DataFrame, most: int = 100) -> DataFrame:
    """The last log lines of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("at"), F.desc("line_no"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def registry_status(sources: DataFrame, counts: DataFrame, progress: DataFrame) -> DataFrame:
    """The registry with record counts (0 if none) and run status (idle if none)."""
    out = sources.join(counts.select("source", F.col("n").alias("records")), "source", "left").join(progress.select("source", F.col("status").alias("run_status")), "source", "left")
    return out.withColumn("records", F.coalesce("records", F.lit(0))).withColumn("run_status", F.coalesce("run_status", F.lit("idle")))
