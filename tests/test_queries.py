"""Every query that has an SQL twin against DuckDB, and the contract of the entry module."""

import math
import os

import pytest

from quillrank import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
QUICK = ("v1_scores", "audit_weighted_variants", "metrics_precision_recall", "failure_classes", "hybrid_scores", "v2_scores", "upsert_merge", "status_toggle", "deterministic_id", "synonym_expand", "parse_amount", "v4_scores", "v5_scores", "v5_interpreted_scores", "v5_explained_top10", "interpreted", "title_signals", "mission_phrases", "result_tabs", "unified_results", "export_csv", "export_raw_csv", "coerced_records", "coerced_profiles", "run_log", "run_report", "v2_explained_top10", "hybrid_explained_top10", "v3_explained_top10", "v4_explained_top10", "sweep_versions", "hybrid_risks", "v3_risks", "v4_risks", "registry_progress", "latest_log", "live_opportunities", "ellipsized", "first_languages", "compare_profile_variant")


def rows(table, columns):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(plain(v) for v in r) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(map(tuple, got.select(columns).collect()), columns) == rows(want.select(*columns).fetchall(), columns)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry_module(spark):
    import __spark_entry__ as entry

    top = entry.entry(spark)
    assert top.columns == ["org_id", "id", "source", "total", "rank"] and top.count() == 250
    assert set(entry.oracle_sql()) <= set(entry.queries())
