"""The normalizers against their rules, character by character, and how often they pass over a text."""

import re

from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import analysis

TEXTS = ["", "  ", "A-b  C", "\tx y z\u0085w", "Ünï 9\U0001f600q", "ends.", ".starts", "a\x1fb\x0bc", "Σİi", None, "3 - - 4", "don't\nstop"]


def test_tokens_and_normal_form(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in rows.select("t", T.raw_tokens(F.col("t")).alias("raw"), T.norm_text(F.col("t")).alias("norm"), F.lower("t").alias("low")).collect():
        want = re.findall("[a-z0-9]+", r["low"]) if r["t"] is not None else None
        assert r["raw"] == want and r["norm"] == (" ".join(want) if want is not None else None)


def test_normal_form_of_joined_texts(spark):
    rows = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "a string, b string")
    whole = T.norm_text(F.concat_ws(" ", "a", "b"))
    parts = T.norm_joined(T.norm_text(F.col("a")), T.norm_text(F.col("b")))
    assert rows.where(~whole.eqNullSafe(parts)).count() == 0


def test_one_expression_passes_over_a_text(spark):
    told = lambda c: spark.range(1).select(F.concat("id", F.lit("")).alias("t")).select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert told(T.norm_text(F.col("t"))).count("regexp_replace(") == 1
    assert told(T.raw_tokens(F.col("t"))).count("regexp_replace(") == 0


def test_groups_are_looked_up_among_the_tokens_they_use(spark):
    said = T.in_groups(F.expr("array('zebra', 'food', 'data', 'food', null, 'bank')"))
    assert spark.range(1).select(said).first()[0] == ["food", "data", "bank"]
    got = spark.range(1).select(T.groups_present(said), T.expand_synonyms(F.expr("array('food', 'bank')")), T.expand_synonyms(F.expr("cast(null as array<string>)"))).first()
    assert got[0] == ["food security", "technology"] and got[1][:2] == ["food", "bank"] and "hunger" in got[1] and got[2] is None


def test_terms_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, "c"), (1, "a a")], "k long, t string")
    top = analysis.term_counts(rows, "k", F.split("t", " "))
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, top.collect())) == [(1, "a", 3, 1), (1, "b", 2, 2), (2, "c", 1, 1)]
