"""Plans over all pairs: what is scored stays out of the joins that make the pairs."""

from pyspark.sql import functions as F

from quillrank.operators import analysis, ranking
from quillrank.operators import scoring_v1 as v1
from quillrank.operators.pairs import pair_up


def scored(spark):
    """Four scored pairs; the second organization is eligible nowhere."""
    opps, orgs = spark.sql("select * from values ('a', 3L), ('b', 0L) as t(id, n)"), spark.sql("select * from values ('x', 2L), ('y', -9L) as t(id, k)")
    pairs = pair_up(opps, orgs).withColumn("total", F.greatest(F.lit(0), F.col("n") * F.col("org_k"))).withColumn("passes_eligibility", F.col("org_k") > 0)
    applied = F.array(*[F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in (("p", F.col("total")), ("q", F.col("n")))])
    out = pairs.withColumn("penalties", F.filter(applied, lambda p: p["value"] > 0))
    return out.withColumn("risks", F.transform("penalties", lambda p: F.concat(F.lit("Risk "), p["type"], F.lit(" — of "), p["value"].cast("string"))))


def pairings(df):
    """The optimized plan's joins of everything with everything, with their conditions."""
    told = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.split("Join Cross", 1)[1].replace(", rightHint=(strategy=broadcast)", "") for line in told if "Join Cross" in line]


def test_no_score_sinks_into_the_join(spark):
    risks, sums = analysis.risk_counts(scored(spark)), analysis.penalty_sums(scored(spark))
    assert pairings(risks) == [""] and pairings(sums) == [""]
    assert sorted(map(tuple, risks.collect())) == [("x", "Risk p", 1), ("x", "Risk q", 1)]
    assert sorted(map(tuple, sums.collect())) == [("x", "p", 6, 1), ("x", "q", 3, 1), ("y", "q", 3, 1)]


def test_items_of_null_and_empty_lists(spark):
    rows = spark.sql("select * from values ('a', array('x', null)), ('a', array()), ('b', null) as t(org_id, items)")
    assert set(map(tuple, analysis.each_of(rows, rows["items"], "item").collect())) == {("a", "x"), ("a", None)}


def test_texts_are_fetched_for_ranked_rows_only(spark):
    """Neither a sort nor a shuffle of the ranking carries an opportunity's text."""
    opps = spark.sql("select 'a' as id, 1L as ord, 'grants_gov' as source, 'health grant' as title, 'health text' as description, array('nonprofit') as eligibility, array('Ohio') as geography, array('health') as keywords, array('care') as categories, 'grant' as funding_type, 10L as min_award, 100L as max_award")
    orgs = spark.sql("select 'o' as id, 'nonprofit' as org_type, 'better health' as mission, array('health') as keywords, array('care') as program_areas, array('youth') as population_served, array('Ohio') as geography, 1000d as annual_budget, 3d as years_in_operation, true as has_501c3, false as is_small_business")
    top = v1.reasons_v1(v1.ranked_v1(opps, orgs, 5))
    (row,) = top.select("org_id", "id", "rank", "total", "reasons", "description").collect()
    want = ranking.top_k(v1.v1_scores(opps, orgs), 5).select("total").first()
    assert row[:4] == ("o", "a", 1, want["total"]) and row["description"] == "health text" and row["reasons"]
    ranks = v1.reasons_v1(v1.ranked_v1(opps, orgs, 5)).select("org_id", "reasons")._jdf.queryExecution().optimizedPlan()
    windows = [line for line in ranks.toString().splitlines() if "Window [" in line or "WindowGroupLimit [" in line]
    assert windows
    numbered = lambda plan: plan.getClass().getSimpleName() == "Window"
    todo, carried = [ranks], []
    while todo:
        plan = todo.pop()
        if numbered(plan):
            carried += plan.output().mkString(" ").split()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    assert carried and not any(c.startswith(("description#", "title#", "keywords#")) for c in carried)
