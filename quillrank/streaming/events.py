"""User events: validation, keyed status, labels, and incremental ingest, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed_store import KeyedStore
from ..sources.landed import normalize

#: The accepted event types.
EVENT_TYPES = ("user.created", "document.uploaded", "opportunity.viewed", "opportunity.analyzed", "opportunity.saved", "opportunity.applied", "opportunity.outcome")
STATUS = {"opportunity.saved": "saved", "opportunity.applied": "applied"}


def valid_events(events: DataFrame) -> DataFrame:
    """Events of a known type with a user; works on streams too."""
    return events.where(F.col("event_type").isin(*EVENT_TYPES) & (F.coalesce(F.col("source_user_id").cast("string"), F.lit("")) != ""))


def refusal(late: str | None = None) -> Column:
    """Why an event is refused: an unknown type, no user, or, with `late`, that it arrived (received_at) more than that after it happened (ts); null for one that is accepted."""
    why = F.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "unknown type").when(F.coalesce(F.col("source_user_id").cast("string"), F.lit("")) == "", "no user")
    return why.when(F.col("ts").isNull() | (F.col("ts") + F.expr(f"interval {late}") < F.col("received_at")), "late") if late else why


def accepted(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events that aren't refused, each event_id once, by the first to arrive. On a stream, repeats are known for `late` after the first; in a batch, for good."""
    good = events.where(refusal(late).isNull())
    if events.isStreaming:
        return good.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["event_id"])
    w = Window.partitionBy("event_id").orderBy("received_at", "ts")
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def refused(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The other events, with the reason; streams too."""
    return events.withColumn("reason", refusal(late)).where("reason is not null")


def event_feed(events: DataFrame, store: str, checkpoint: str, late: str = "1 hour") -> list[StreamingQuery]:
    """A stream of events into two appended tables, store/accepted and store/refused. Either's files belong to a micro-batch as a whole, so a repeated one adds nothing. Both stop when all is read."""
    parts = {"accepted": accepted(events, late), "refused": refused(events, late)}
    return [rows.writeStream.format("parquet").option("path", f"{store}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start() for name, rows in parts.items()]


def toggled_status(events: DataFrame) -> DataFrame:
    """The status of each (user, opportunity) after all its saved and applied events in order of time.

    The same status again removes an entry, another one replaces it. So the last run of equal statuses decides: with an odd number of events the status stands. Events at the same
    time are taken in order of event_id. A key's events are ordered by a window, which spills.
    """
    status = F.coalesce(*[F.when(F.col("event_type") == t, s) for t, s in STATUS.items()])
    rows = valid_events(events).withColumn("status", status).where("status is not null and opp_id is not null")
    w = Window.partitionBy("source_user_id", "opp_id").orderBy("ts", "event_id")
    change = F.coalesce((F.lag("status").over(w) != F.col("status")).cast("int"), F.lit(1))
    runs = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).groupBy("source_user_id", "opp_id", "run", "status").agg(F.count(F.lit(1)).alias("n"))
    last = runs.groupBy("source_user_id", "opp_id").agg(F.max(F.struct("run", "status", "n")).alias("r"))
    return last.where("r.n % 2 = 1").select("source_user_id", "opp_id", "r.status")


def _toggle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Only the last run of equal statuses counts, and whether its length is odd; a run that begins with the batch goes on from the state."""
    now = state.get[0] if state.exists else None
    s = pd.concat(list(batches)).sort_values(["ts", "event_id"])["status"].to_numpy()
    changes = (s[1:] != s[:-1]).nonzero()[0]
    start = int(changes[-1]) + 1 if len(changes) else 0
    n = len(s) - start + (start == 0 and now == s[-1])
    now = s[-1] if n % 2 else None
    state.update((now,))
    yield pd.DataFrame({"source_user_id": [key[0]], "opp_id": [key[1]], "status": [now]})


def toggled_status_stream(events: DataFrame) -> DataFrame:
    """The streaming form of `toggled_status`: one update per key and micro-batch, null where the entry was removed. Late events count when they arrive."""
    status = F.coalesce(*[F.when(F.col("event_type") == t, s) for t, s in STATUS.items()])
    rows = valid_events(events).withColumn("status", status).where("status is not null and opp_id is not null").select("source_user_id", "opp_id", "status", "ts", "event_id")
    return rows.groupBy("source_user_id", "opp_id").applyInPandasWithState(_toggle, "source_user_id long, opp_id string, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def latest_labels(labels: DataFrame, key: list[str], at: str = "ts") -> DataFrame:
    """The last label of each key."""
    return labels.groupBy(*key).agg(F.max_by("label", at).alias("label"))


def event_counts(events: DataFrame) -> DataFrame:
    return valid_events(events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_user_id").alias("users"))


def ingest_stream(spark: SparkSession, landing: str, store: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Landed payload files (JSON lines of source, payload, landed_at) into the record store, a micro-batch at a time.

    A micro-batch rewrites only the buckets of the store that its records fall into, and is version n of the store: run again after a failure, it changes nothing that was committed. KeyedStore
    reads the records, and its history has the counters of every batch. Stops when all landed files are read; `files` bounds a micro-batch.
    """

    def merge(batch: DataFrame, n: int) -> None:
        KeyedStore(spark, store).merge(normalize(batch), n, F.struct("normalized_at", "raw_payload"))

    landed = spark.readStream.schema("source string, payload string, landed_at timestamp").option("maxFilesPerTrigger", files).json(landing)
    return landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
