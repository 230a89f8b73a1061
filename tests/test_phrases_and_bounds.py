"""The phrase automaton against plain substring tests, and rankings by bounds against rankings of all pairs."""

import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank import plans
from quillrank.functions import lexicons, phrases
from quillrank.operators import bounds, ranking
from quillrank.operators import scoring_hybrid as hybrid
from quillrank.operators import scoring_v2 as v2
from quillrank.operators import scoring_v3 as v3
from quillrank.operators import scoring_v4 as v4
from quillrank.operators import taxonomy as tx
from quillrank.operators.pairs import pair_up
from quillrank.plans import queries_v2, queries_v4
from quillrank.sources import views
from quillrank.sources.staging import staged

SF = "/root/testdata/sf0.001"


def texts(n=200):
    deal = random.Random(11)
    words = [w for p in (*v4.CONCEPTS, *lexicons.every_word(lexicons.SECTORS)) for w in p.lower().split()]
    return [" ".join(deal.choice(words) + deal.choice(["", "", "s", "ed"]) for _ in range(deal.randint(0, 60))) for _ in range(n)] + ["", "a", None]


def test_automaton_equals_substring_tests():
    listed = ("he", "she", "hers", "his", "e", "he", "", "ish he", "é")
    for text in ("ushers", "she is his", "", "hé", None, "h" * 1000):
        want = [i for i, p in enumerate(listed) if text is not None and p in text]
        assert phrases.search(pa.array([text], pa.string()), listed).to_pylist() == [want]
    assert phrases.search(pa.array(["abc", None]), ()).to_pylist() == [[], []]


def test_tags_and_phrases_equal_substring_tests(spark):
    rows = texts()
    table = spark.createDataFrame(list(enumerate(rows)), "i long, t string").repartition(3)
    got = table.select("i", phrases.contained(F.col("t"), v4.CONCEPTS).alias("p"), lexicons.tags(F.col("t"), lexicons.SECTORS).alias("s"), tx.domain_phrases(F.col("t")).alias("d"), tx.domain_scores(F.col("t")).alias("v"), tx.population_tags(F.col("t")).alias("pop")).collect()

    def alone(text, words):
        wide = " " + "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text) + " "
        return any(w in text and " " + "".join(c if c.isalnum() or c == "_" else " " for c in w) + " " in wide for w in words)

    for r in got:
        t = rows[r["i"]]
        if t is None:
            assert r["p"] == [] and r["s"] == []
            continue
        assert r["p"] == [p for p in v4.CONCEPTS if p in t]
        assert r["s"] == [tag for tag, words in lexicons.SECTORS.items() if any(w in t for w in words)]
        assert r["d"] == [p for p in dict.fromkeys(p for e in tx.DOMAINS for p in e[3]) if p in t]
        hits = [sum(p in t for p in e[3]) for e in tx.DOMAINS]
        assert r["v"] == [n * e[2] if n else int(e[2] * 0.4 + 0.5) if alone(t, e[4]) else 0 for n, e in zip(hits, tx.DOMAINS, strict=True)]
        assert r["pop"] == [tag for tag, (some, words) in tx.POPULATIONS.items() if any(p in t for p in some) or alone(t, words)]


def test_time_does_not_follow_the_number_of_phrases():
    deal = random.Random(2)
    text = pa.array(["".join(deal.choices("abcdefgh ", k=200_000))])
    few, many = (tuple("zz" + "".join(deal.choices("ijklmnop", k=12)) for _ in range(n)) for n in (10, 5_000))
    took = []
    for listed in (few, many):
        phrases.search(text, listed)
        began = time.perf_counter()
        for _ in range(5):
            phrases.search(text, listed)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05  # 500 times as many


def test_bits():
    with pytest.raises(ValueError):
        lexicons.bits("x", [str(i) for i in range(64)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", ["v2", "hybrid", "v3", "v4"])
def test_bounded_ranking_equals_the_ranking_of_all_pairs(spark, name):
    pool, orgs = queries_v2._pool(spark, SF), views.organizations(spark, SF)
    scorer = {"v2": v2, "hybrid": hybrid, "v3": v3, "v4": v4}[name]
    score = getattr(scorer, f"score_{name}")
    mine, own = scorer.bounded_sides(pool, orgs, *[queries_v4._as_of()] * (name == "v4"))
    mine, bound = staged(mine, "t"), scorer.bound()
    scored = score(pair_up(mine, own).withColumn("most", bound)).select("org_id", "id", "ord", "source", "passes_eligibility", "total", "most")
    scored = staged(scored, "all")
    assert scored.where("passes_eligibility and total > 0 and (most is null or most < total)").count() == 0
    keys = ["org_id", "id", "total", "rank"]
    for cap, least in ((3, 25),) if name in ("hybrid", "v4") else ((None, 1),):
        want = ranking.capped_top_k(scored, 10, cap, least=least) if cap else ranking.top_k(scored, 10, least=least)
        got = bounds.best(mine, own, bound, score, 10, cap, least, least_pairs=0)
        assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
@pytest.mark.parametrize("name", ["v4"])
def test_few_pairs_are_scored_in_full(spark, name):
    sf = "/root/testdata/sf0.01"
    scorer = {"v2": v2, "v4": v4}[name]
    mine, own = scorer.bounded_sides(queries_v2._pool(spark, sf), views.organizations(spark, sf), *[queries_v4._as_of()] * (name == "v4"))
    mine = staged(mine, "t")
    left = bounds.candidates(mine, own, scorer.bound(), getattr(scorer, f"score_{name}"), lambda rows: ranking.top_k(rows, 10), 10, 1, 200, ("org_id",))
    assert left.count() <= 0.1 * 25 * mine.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_no_score_sinks_into_the_join(spark, monkeypatch):
    monkeypatch.setattr(bounds.best, "__defaults__", (*bounds.best.__defaults__[:-1], 0))  # rankings by bounds, however few the pairs
    known = plans.queries()
    for name in ("v1_top10", "v5_top10", "v4_capped_top10", "v3_top10"):
        joins = [line for line in known[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line or "Join Cross" in line]
        assert joins and max(map(len, joins)) < 10_000, (name, max(map(len, joins)))
        assert not any(costly in line for line in joins for costly in ("body_norm", "org_words", "org_places", "org_weights")), name
