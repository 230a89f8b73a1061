"""The hybrid's ranking over many rows: texts are read once, pairs are compared by bits and lists of points, and not all of them are sorted."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillrank.functions import phrases
from quillrank.operators import bounds, pairs
from quillrank.operators import scoring_hybrid as hybrid
from quillrank.operators import scoring_v1 as v1
from quillrank.operators import scoring_v2 as v2
from quillrank.plans import queries_v2
from quillrank.sources import views
from quillrank.sources.staging import staged

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_parts_of_a_text():
    deal = random.Random(3)
    some = lambda letters, n: "".join(deal.choice(letters) for _ in range(deal.randint(0, n)))
    for _ in range(2000):
        anywhere, heads = tuple(some("ab ", 3) for _ in range(4)), tuple({some("ab ", 3) for _ in range(4)} - {""})
        tokens, text = tuple({some("ab", 3) for _ in range(3)} - {""}), some("ab _é", 14)
        end = deal.randint(0, len(text))
        places = [i for i, p in enumerate(anywhere) if p in text] + [4 + i for i, p in enumerate(heads) if p in text[:end]] + [4 + len(heads) + i for i, t in enumerate(tokens) if t in re.findall("[a-z0-9]+", text)]
        assert phrases.search_parts(pa.array([text]), pa.array([end], pa.int32()), anywhere, heads, tokens).to_pylist() == [places]
    assert phrases.search_parts(pa.array([None, "x"]), pa.array([0, 0], pa.int32()), ("",), ("x",), ()).to_pylist() == [[], [0]]


@tables
def test_features_equal_those_of_each_scorer(spark):
    """Texts with nulls, phrases across the border of title and description, and letters whose lower case is longer."""
    deal = random.Random(5)
    words = "track record prior federal experience established procurement ta capacity build training workforce for and all health_care HEALTH housing ΑΣ İstanbul _ 9 job training women-owned audit".split() + ["prior federal", "track record"]
    text = lambda n: None if deal.random() < 0.1 else deal.choice([" ", "-", "_"]).join(deal.choice(words) for _ in range(deal.randint(0, n)))
    listed = lambda: None if deal.random() < 0.1 else [text(2) for _ in range(deal.randint(0, 3))]
    pool, orgs = queries_v2._pool(spark, SF), views.organizations(spark, SF)
    one = pool.first().asDict()
    rows = [one | {"id": f"x{i}", "title": text(3), "description": text(4), "keywords": listed(), "categories": listed()} for i in range(400)]
    odd = spark.createDataFrame([tuple(r[f.name] for f in pool.schema) for r in rows], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema))
    mine, own = hybrid.sides(odd, orgs)
    want = v1.with_opp_columns(odd).withColumn("tokens", pairs.only("tokens", pairs.said_by(own, "tokens")))
    keys = lambda rows: rows.select("id", F.array_sort("tokens").alias("tokens"), "wants_experience", "nonprofit_only", "business_only").collect()
    assert sorted(map(tuple, keys(mine)), key=str) == sorted(map(tuple, keys(want)), key=str)
    body = F.lower(F.concat_ws(" ", "title", "description"))
    said = v2.read_texts(odd).select(body.alias("body"), *[v2.said(w).alias(w) for w in v2.BODY_WORDS])
    assert all(r[w] == (w in r["body"]) for r in said.collect() for w in v2.BODY_WORDS)


@tables
def test_texts_are_read_once(spark):
    mine, _ = hybrid.sides(queries_v2._pool(spark, SF), views.organizations(spark, SF))
    plan = mine._jdf.queryExecution().optimizedPlan().toString()
    assert "split(lower(description" not in plan and plan.count("Contains(") + plan.count("contains(") <= 20  # each word once for each use before: 60 and more, besides all tokens


def test_highest_bounds(spark):
    deal = random.Random(7)
    rows = [(f"o{deal.randint(0, 2)}", f"d{i}", i // 2, deal.choice(["a", "b", None]), deal.choice([None, 1, 2, 3, 3, 3])) for i in range(600)]
    bounded = staged(spark.createDataFrame(rows, "org_id string, id string, ord long, source string, most int").repartition(3), "b")
    for by in (("org_id",), ("org_id", "source")):
        for n in (1, 7, 500):
            place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("most"), F.asc("ord")))
            want = bounded.withColumn("_n", place).where((F.col("_n") <= n) & F.col("most").isNotNull())
            key = [*by, "most", "ord"]
            null_safe = lambda rows: sorted(map(tuple, rows.select(*key).collect()), key=str)
            assert null_safe(bounds.highest(bounded, n, by)) == null_safe(want)


@tables
def test_pairs_are_compared_by_short_rows(spark):
    mine, own = hybrid.bounded_sides(queries_v2._pool(spark, SF), views.organizations(spark, SF))
    plan = pairs.pair_up(staged(mine, "t"), own).select("id", hybrid.bound())._jdf.queryExecution().optimizedPlan().toString()
    for long in ("org_weights", "eligibility#", "elig#", "org_geo#", " sectors#", "arrays_overlap", "array_contains"):
        assert long not in plan.split("Join")[0], long
