"""Landed pages through the data source: shapes of pages, what is planned and read under filters, cursors, and the entry module without its optional parts."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from quillrank.sources import landed_pages as lp

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def landing(spark, tmp_path):
    rows = [("sam_gov", i // 3, json.dumps({"noticeId": f"{i}", "postedDate": f"2026-01-{i + 1:02d}", "active": "yes" if i < 6 else "no", "extra": i})) for i in range(9)]
    rows += [("usaspending", i // 2, json.dumps({"Award ID": f"u{i}", "Start Date": f"2026-02-{i + 1:02d}"})) for i in range(5)]
    rows += [("world_bank", 0, json.dumps({"id": "w1", "status": None})), ("sbir", 0, json.dumps({"solicitation_id": "s1"}))]
    path = f"file://{tmp_path}/landing"
    listed = lp.land_pages(spark.createDataFrame(rows, "source string, page long, payload string"), path, "2026-04-01T00:00:00+00:00").cache()
    lp.list_pages(spark, listed, path)
    assert listed.count() == 8
    return path


def key(table):
    return sorted((r["source"], r["page"], r["item"], r["posted"], r["status"]) for r in table.collect())


def test_pages_come_back_whole(spark, landing):
    rows = lp.read_pages(spark, landing).collect()
    assert len(rows) == 16 and {r["source"] for r in rows} == {"sam_gov", "usaspending", "world_bank", "sbir"}
    assert [r["posted"] for r in sorted(rows, key=lambda r: (r["source"], r["page"], r["item"])) if r["source"] == "usaspending"] == [f"2026-02-{i:02d}" for i in range(1, 6)]
    assert {r["landed_at"] is None for r in rows if r["source"] == "sbir"} == {True} and {r["landed_at"] is None for r in rows if r["source"] == "sam_gov"} == {False}


def test_filters_give_the_rows_of_an_unpushed_read(spark, landing):
    tests = ("posted >= '2026-01-05'", "posted < '2026-01-03' and source = 'sam_gov'", "status = 'no'", "status is not null and page in (0, 2)", "source in ('usaspending', 'sbir')", "posted = '2026-02-03'", "posted like '%-03'", "posted >= '2026-01-05' or status = 'yes'", "page > 0 and posted > '2026-01-01'")
    whole = lp.read_pages(spark, landing)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    plain = {t: key(whole.where(t)) for t in tests}
    for t in tests:
        assert key(lp.read_pages(spark, landing, pages=1).where(t)) == plain[t], t


def test_planning_leaves_out_what_filters_rule_out(landing):
    def planned(*filters, pages=1):
        reader = lp.LandedReader({"path": landing, "pages": str(pages)})
        left = list(reader.pushFilters(list(filters)))
        return left, [(p.source, [n for n, _ in p.names]) for p in reader.partitions()]

    everything = planned()[1]
    assert everything == [("sam_gov", [0]), ("sam_gov", [1]), ("sam_gov", [2]), ("sbir", [0]), ("usaspending", [0]), ("world_bank", [0])]
    assert planned(EqualTo(("source",), "sam_gov"), GreaterThanOrEqual(("posted",), "2026-01-07")) == ([], [("sam_gov", [2])])
    assert planned(EqualTo(("source",), "sam_gov"), EqualTo(("status",), "yes"), pages=5) == ([], [("sam_gov", [0, 1])])
    assert planned(In(("source",), ("sbir",)), LessThan(("posted",), "2026"))[1] == []
    kept = StringContains(("payload",), "x")
    assert planned(kept)[0] == [kept]


def test_fields_keep_some_of_an_item(spark, landing):
    rows = lp.read_pages(spark, landing, fields=("noticeId",)).where(F.col("source") == "sam_gov").collect()
    assert {tuple(json.loads(r["payload"])) for r in rows} == {("noticeId",)} and rows[0]["posted"] is not None


def test_shapes_of_pages():
    assert lp.items_of("world_bank", {"projects": {"a": {"id": "1"}, "total": "7", "b": {"total": 3}, "c": None, "d": {"id": "2"}}}) == [{"id": "1"}, {"id": "2"}]
    assert lp.items_of("world_bank", {"projects": [{"id": "1"}, None]}) == [{"id": "1"}]
    assert lp.items_of("nsf_awards", {"response": {"award": [{"id": 1}]}}) == [{"id": 1}] and lp.items_of("nsf_awards", {}) == []
    assert lp.items_of("sbir", [{"id": 1}, "x"]) == [{"id": 1}] and lp.items_of("sbir", {"data": None}) == []


@pytest.mark.parametrize("missing", ["public_tokenizers", "quillrank.llm", "corpus_pipeline"])
def test_entry_module_without_optional_parts(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 106 and out[1:] == ["False", "True"]
