"""The one-pass sweep against plain loops, with ties, nulls, a source that holds most rows, and an empty pool."""

import math
import random

from quillrank.operators.sweep import TYPES, sweep

SCHEMA = "org_id string, id string, ord long, source string, passes_eligibility boolean, total long, d1 long, d2 long, boost long, type string, complexity int"


def pool(n=3000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        total = rng.choice([None, 0, 1, 10, 11, 50, 51, 85, 86, 100])
        rows.append((f"org_{rng.randrange(3)}", f"x{i}", i, source, rng.choice([True, True, True, False, None]), total, rng.randrange(20), rng.randrange(5), rng.randrange(4), rng.choice([*TYPES[:3], None]), rng.choice([0, 1, 2, 3, None])))
    return rows


def half_up(x):
    return math.floor(x + 0.5)


def plainly(rows, org, k):
    mine = [r for r in rows if r[0] == org]
    ok = [r for r in mine if r[4]]
    hit = [r for r in ok if (r[5] or 0) > 0]
    sources = []
    for source in sorted({r[3] for r in mine}, key=lambda s: (s is not None, s or "")):
        of = [r[5] for r in hit if r[3] == source]
        sources.append((source, sum(r[3] == source for r in mine), sum(r[3] == source for r in ok), len(of), half_up(sum(of) / len(of) * 100) if of else 0, max(of, default=0)))
    return {
        "active": len(mine), "ineligible": len(mine) - len(ok), "eligible_zero": len(ok) - len(hit), "scored": len(hit), "above_50": sum(r[5] > 50 for r in hit), "above_85": sum(r[5] > 85 for r in hit),
        "histogram": [sum(min(9, (r[5] - 1) // 10) == i for r in hit) for i in range(10)], "types": [sum(r[9] == t for r in hit) for t in TYPES], "complexities": [sum(r[10] == i for r in hit) for i in range(4)],
        "dimension_tenths": [half_up(sum(r[d] for r in hit) / len(hit) * 10) for d in (6, 7)], "boosts": [sum(r[8] for r in hit)], "by_source": sources,
        "best": [(r[5], r[1], [r[6], r[7]]) for r in sorted(hit, key=lambda r: (-r[5], r[2]))[:k]],
    }


def test_sweep_equals_plain_loops(spark):
    rows = pool()
    got = {r["org_id"]: r.asDict(recursive=True) for r in sweep(spark.createDataFrame(rows, SCHEMA).repartition(7), ("d1", "d2"), ("boost",), k=50).collect()}
    assert set(got) == {"org_0", "org_1", "org_2"}
    for org, row in got.items():
        want = plainly(rows, org, 50)
        row["by_source"] = [tuple(s.values()) for s in row["by_source"]]
        row["best"] = [tuple(b.values()) for b in row["best"]]
        assert {n: row[n] for n in want} == want


def test_sweep_of_little(spark):
    assert sweep(spark.createDataFrame([], SCHEMA), ("d1",)).count() == 0
    row = sweep(spark.createDataFrame([("o", "x", 1, None, False, 0, 1, 1, 0, None, None)], SCHEMA), ("d1",), profiled=False).first()
    assert (row["active"], row["ineligible"], row["scored"], row["dimension_tenths"], row["best"], row["types"], row["boosts"]) == (1, 1, 0, [None], [], [], [])


def test_pool_is_read_once_and_not_shuffled_whole(spark):
    """Below the first exchange the pool is aggregated already, best rows included."""
    plan = sweep(spark.createDataFrame(pool(50), SCHEMA), ("d1", "d2"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate(keys=[org_id") == 4  # a partial and a final one by source, and again by organization
    assert plan.count("Scan ExistingRDD") == 1 and "Window" not in plan and "Join" not in plan
