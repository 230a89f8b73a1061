"""Exports as files, the event feed in batch and as a stream, profile updates, and fixture files."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from quillrank.operators import exports, reports, store
from quillrank.sources import uploads
from quillrank.streaming import events


def files(path):
    return {d.split("org_id=")[1]: open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names if f.endswith(".txt")}


def test_export_files_are_whole_and_in_order(spark, tmp_path):
    rows = [("o1", 2, 'b "x"', "a|b"), ("o2", 1, None, ""), ("o1", 1, "ä,1", "z"), ("o1", 10, "k", ""), ("o1", 3, "c", "")]
    table = spark.createDataFrame(rows, "org_id string, rank long, title string, why string").repartition(3)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    exports.write_csv(table.select("org_id", "rank", F.concat_ws(",", F.col("rank").cast("string"), quoted("title")).alias("line")), ("Rank", "Title"), str(tmp_path / "csv"))
    got = files(tmp_path / "csv")
    assert list(csv.reader(got["o1"].splitlines())) == [["Rank", "Title"], ["1", "ä,1"], ["2", 'b "x"'], ["3", "c"], ["10", "k"]] and list(csv.reader(got["o2"].splitlines())) == [["Rank", "Title"], ["1", ""]]
    exports.write_json(table.select("org_id", "rank", "title", reports.json_line("rank", "title").alias("line")), {"best": F.min_by("title", "rank")}, str(tmp_path / "json"))
    made = {k: json.loads(v) for k, v in files(tmp_path / "json").items()}
    assert made["o1"] == {"org_id": "o1", "best": "ä,1", "count": 4, "results": [{"rank": 1, "title": "ä,1"}, {"rank": 2, "title": 'b "x"'}, {"rank": 3, "title": "c"}, {"rank": 10, "title": "k"}]}
    assert made["o2"] == {"org_id": "o2", "count": 1, "results": [{"rank": 1}]}
    exports.write_csv(table.limit(0).select("org_id", "rank", F.lit("").alias("line")), ("Rank",), str(tmp_path / "none"))
    assert files(tmp_path / "none") == {}


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    table = spark.createDataFrame([(f"o{i}", 1, str(i)) for i in range(8)], "org_id string, rank long, line string")
    broken = table.withColumn("line", F.when(F.col("line") == "5", F.raise_error(F.lit("killed"))).otherwise(F.col("line")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        exports.write_csv(broken, ("Line",), str(tmp_path / "out"))
    assert files(tmp_path / "out") == {}


EVENTS = [
    # event_id, ts, received_at, type, user
    (1, "10:00", "10:01", "opportunity.viewed", "u"), (1, "10:00", "10:05", "opportunity.viewed", "u"), (2, "10:02", "10:02", "nonsense", "u"), (3, "10:03", "10:03", "user.created", None), (4, "08:00", "10:04", "opportunity.saved", "u"),
    (5, "10:05", "10:06", "opportunity.saved", "v"), (6, None, "10:07", "opportunity.saved", "v"), (7, "10:08", "10:09", None, "v"), (8, "10:30", "10:31", "opportunity.applied", ""), (9, "10:40", "10:40", "opportunity.outcome", "w"), (5, "10:05", "10:20", "opportunity.saved", "v"),
]


def test_event_feed_ends_alike_in_batch_and_as_a_stream(spark, tmp_path):
    at = lambda c: F.to_timestamp(F.concat(F.lit("2026-01-01 "), F.col(c)))
    table = spark.createDataFrame(EVENTS, "event_id long, ts string, received_at string, event_type string, source_user_id string").withColumns({"ts": at("ts"), "received_at": at("received_at")})
    for i, lo in enumerate((0, 4, 8)):  # three files, three micro-batches at most
        table.orderBy("received_at").offset(lo).limit(4).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        assert i < 3
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for query in events.event_feed(stream, str(tmp_path / "out"), str(tmp_path / "cp")):
        query.awaitTermination(180)
    keys = lambda rows: sorted((r["event_id"], r["event_type"] or "") for r in rows.collect())
    good, bad = events.accepted(table), events.refused(table)
    assert keys(good) == [(1, "opportunity.viewed"), (5, "opportunity.saved"), (9, "opportunity.outcome")]
    assert {(r["event_id"], r["reason"]) for r in bad.collect()} == {(2, "unknown type"), (3, "no user"), (4, "late"), (6, "late"), (7, "unknown type"), (8, "no user")}
    assert keys(spark.read.parquet(str(tmp_path / "out/accepted"))) == keys(good)
    assert sorted((r["event_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out/refused")).collect()) == sorted((r["event_id"], r["reason"]) for r in bad.collect())


def test_profile_updates_refuse_lost_ones(spark):
    kind = "id string, version long, profile struct<name:string,tags:array<string>>"
    now = spark.createDataFrame([("a", 3, ("A", ["x"])), ("b", 1, None), ("c", 1, ("C", []))], kind)
    updates = [("a", 3, ("A1", None), 1), ("a", 3, ("A2", None), 2), ("a", 2, ("old", None), 0), ("b", 1, ("B", ["y"]), 1), ("c", 1, None, 5), ("d", 1, ("D", None), 1), (None, 1, ("N", None), 1), ("a", 4, ("next", None), 9), ("c", None, ("?", None), 1)]
    after, lost = store.update_profiles(now, spark.createDataFrame(updates, "id string, seen long, profile struct<name:string,tags:array<string>>, at long"))
    assert {r["id"]: (r["version"], r["profile"] and r["profile"]["name"]) for r in after.collect()} == {"a": (4, "A1"), "b": (2, "B"), "c": (2, None)} and after.count() == 3
    assert sorted((r["id"] or "", r["seen"] or 0, r["reason"]) for r in lost.collect()) == [("", 1, "unknown"), ("a", 2, "stale"), ("a", 3, "stale"), ("a", 4, "stale"), ("c", 0, "stale"), ("d", 1, "unknown")]


def test_fixture_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"id": "p1", "name": "One", "mission": "help", "geography": "Ohio", "annual_budget": "5000", "has_501c3": True}, {"org_name": "Two", "keywords": ["a", None, "b"]}]))
    (tmp_path / "two.json").write_text(json.dumps({"id": "p3"}))
    got = {r["name"]: r for r in uploads.fixture_profiles(spark, str(tmp_path)).collect()}
    assert got["One"]["id"] == "p1" and got["One"]["geography"] == ["Ohio"] and got["One"]["annual_budget"] == 5000 and got["One"]["has_501c3"] is True
    assert len(got["Two"]["id"]) == 64 and got["Two"]["keywords"] == ["a", "b"] and got["My Organization"]["id"] == "p3"
