"""How often the interpreter and the title-first scorer go over a text, and words that must stand alone."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillrank.functions import phrases
from quillrank.operators import interpretation
from quillrank.operators import scoring_v5 as v5
from quillrank.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_stand_alone():
    texts = pa.array(["hiv-positive, wick", "shiv wicks", "wick_", "éwick", "", None, "wick wicker", "wicker wick"])
    assert phrases.search(texts, ("wick", "positive"), ("hiv", "wick")).to_pylist() == [[0, 1, 2, 3], [0], [0], [0, 3], [], [], [0, 3], [0, 3]]
    assert phrases.search(texts.slice(0, 2), (), ("wick",)).to_pylist() == [[0], []]


def test_applicants_of_a_text_are_found_in_one_pass(spark):
    told = plan(interpretation.interpret(views.opportunities(spark, SF)).select("id", "applicants"))
    assert told.count("lower(") <= 12  # once for each text, not for each phrase


def test_votes_of_the_description(spark):
    rows = [(1, "nonprofit organizations and universities"), (2, "NGOs"), (3, None)]
    table = spark.createDataFrame(rows, "id int, d string")
    got = table.select("id", interpretation.intended_applicants(F.lit("x"), F.lit("university"), F.lit("nonprofit organization"), F.col("d")).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in got] == [["university", "nonprofit"], ["university", "nonprofit"], ["university", "nonprofit"]]
    got = table.select("id", interpretation.intended_applicants(F.lit("sbir"), F.lit(""), F.lit("academic"), F.col("d")).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in got] == [["small_business", "university"], ["small_business", "university"], ["small_business", "university"]]
    assert table.select(interpretation.intended_applicants(F.lit("x"), F.lit(""), F.lit(""), F.col("d")).alias("a")).first()["a"] == ["any"]


def test_pairs_normalize_no_text(spark):
    pool = interpretation.interpret(views.opportunities(spark, SF))
    scored = v5.score_v5(v5.pairs(pool, views.organizations(spark, SF), True), interpreted=True).select("org_id", "id", "title_mission_fit", "total")
    above = plan(scored).split("Join Cross")[0] if "Join Cross" in plan(scored) else plan(scored).split("Join Inner")[0]
    assert "org_concepts" in above and "regexp_replace" not in above
