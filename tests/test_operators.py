"""Operators on hand-made rows, with values worked out from the rules."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillrank.functions import text as T
from quillrank.operators import analysis, interpretation, ranking, scoring_v1, scoring_v2, scoring_v4, scoring_v5, store, taxonomy
from quillrank.operators.keyed_store import KeyedStore
from quillrank.sources import landed, registry
from quillrank.streaming import events

ORG = dict(
    id="org_001", name="Empower Birth Initiative", org_type="nonprofit", mission="Improve maternal health outcomes for Black women through education, advocacy, and community-based support.",
    program_areas=["maternal health", "health equity", "community education"], population_served=["Black women", "pregnant people", "families"], geography=["Ohio", "United States"], annual_budget=350000.0, years_in_operation=3.0,
    has_501c3=True, is_small_business=False, keywords=["maternal health", "birth equity", "pregnancy", "community health", "advocacy"],
)
OPP = dict(
    id="sg_001", ord=1, source="simpler_grants", title="Maternal and Child Health Equity Initiative FY2026",
    description="Supports community-based organizations addressing racial and ethnic disparities in maternal health outcomes. Priority given to organizations serving Black and Indigenous communities.",
    funding_type="grant", min_award=100000, max_award=500000, eligibility=["nonprofit", "501c3", "community_based_org"], categories=["maternal health", "health equity", "community health"],
    keywords=["maternal mortality", "birth equity", "Black women", "community health", "health disparities"], geography=["United States"],
)
OPP_SCHEMA = "id string, ord long, source string, title string, description string, funding_type string, min_award long, max_award long, eligibility array<string>, categories array<string>, keywords array<string>, geography array<string>"
ORG_SCHEMA = "id string, name string, org_type string, mission string, program_areas array<string>, population_served array<string>, geography array<string>, annual_budget double, years_in_operation double, has_501c3 boolean, is_small_business boolean, keywords array<string>"


def opps(spark, *changes):
    return spark.createDataFrame([tuple((OPP | c)[k.split()[0]] for k in OPP_SCHEMA.split(", ")) for c in changes], OPP_SCHEMA)


def orgs(spark, *changes):
    return spark.createDataFrame([tuple((ORG | c)[k.split()[0]] for k in ORG_SCHEMA.split(", ")) for c in changes], ORG_SCHEMA)


def test_keyword_scorer_by_hand(spark):
    r = scoring_v1.v1_scores(opps(spark, {}), orgs(spark, {})).first()
    assert [r[d] for d in scoring_v1.DIMENSIONS] == [60, 18, 10, 5, 4] and r["total"] == 97
    text = scoring_v1.reasons_v1(scoring_v1.v1_scores(opps(spark, {}), orgs(spark, {}))).first()
    assert text["reasons"][0] == "Eligible nonprofit applicant type confirmed" and text["risks"] == []


@pytest.mark.parametrize(
    ("eligibility", "org", "v1", "v2"),
    [
        ([], {}, True, True),
        (["501c3"], {"has_501c3": False}, False, False),
        (["501c3"], {"has_501c3": False, "org_type": "university"}, False, True),
        (["small_business"], {}, False, False),
        (["nonprofit", "small_business"], {"org_type": "small_business", "is_small_business": True, "has_501c3": False}, True, True),
        (["nonprofit"], {"org_type": "other"}, False, False),
        (["all"], {"org_type": "other"}, True, True),
    ],
)
def test_gates(spark, eligibility, org, v1, v2):
    o, p = orgs(spark, org), opps(spark, {"eligibility": eligibility})
    assert scoring_v1.score_v1(scoring_v1.pairs(p, o)).first()["passes_eligibility"] is v1
    assert scoring_v2.score_v2(scoring_v2.pairs(p, o)).first()["passes_eligibility"] is v2


def test_capped_walk_equals_window(spark):
    rng = random.Random(3)
    rows = [("o", f"s{rng.randrange(4)}", i, rng.randrange(1, 6), True) for i in range(60)]
    got = ranking.capped_top_k(spark.createDataFrame(rows, "org_id string, source string, ord int, total int, passes_eligibility boolean"), k=10, cap=2)
    taken, n = [], {}
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        if n.get(r[1], 0) < 2 and len(taken) < 10:
            n[r[1]] = n.get(r[1], 0) + 1
            taken.append(r[2])
    assert [r["ord"] for r in got.orderBy("rank").collect()] == taken


def test_histogram_edges_and_upper_median(spark):
    rows = [("o", s, True) for s in (0, 1, 10, 11, 100, 42)] + [("o", 99, False)]
    scored = spark.createDataFrame(rows, "org_id string, total int, passes_eligibility boolean")
    assert [r["n"] for r in analysis.histogram(scored).orderBy("bin").collect()] == [2, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    assert analysis.upper_median(scored).first()["median_score"] == 11


def test_text_primitives(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(T.tokenize, "The A-1 café ABC abc") == ["the", "caf", "abc", "abc"]
    assert one(T.normalize_phrase, "Low–Income, K-12  Kids") == "low income k kids"
    assert [one(T.parse_amount, v) for v in ("$1,234.50", "12 USD", "0", "-3", "x", None, "1e3")] == [1235, 12, None, None, None, None, 1000]
    assert [one(T.parse_live_amount, v) for v in ("$1,234.5", "none", "0")] == [1234.5, None, None]
    assert one(T.parse_date, "rolling") is None and one(T.parse_date, "2026-03-01").year == 2026
    h = 0
    for c in "sbir::12":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert one(T.record_id_hash, "sbir::12") == f"idx_{digits}_sbir__12"
    assert one(registry.source_key, "SBIR (via USASpending)") == "sbir" and one(registry.source_key, "TED EU") == "ted_eu"


def test_upsert_refreshes_some_columns_and_is_idempotent(spark):
    schema = "dedupe_key string, title string, funding_type string"
    old = spark.createDataFrame([("a", "A", "grant"), ("b", "B", "grant")], schema)
    new = spark.createDataFrame([("a", "A2", "loan", 1), ("c", "C1", "x", 1), ("c", "C2", "y", 2), (None, "N", "z", 3)], schema + ", n int")
    once = store.upsert(old, new, "dedupe_key", F.col("n"))
    want = [("a", "A2", "grant"), ("b", "B", "grant"), ("c", "C2", "x")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert(once, new, "dedupe_key", F.col("n")).collect())) == want
    assert store.upsert_counts(old, new, "dedupe_key").first() == Row(inserted=1, updated=2, errors=1)


def test_normalizers(spark):
    payloads = [
        ("simpler_grants", '{"opportunity_id": 7, "summary": {"summary_description": "' + "d" * 700 + '", "award_ceiling": "$1,200", "applicant_types": ["a", "", "b"]}, "category": "x"}'),
        ("sam_gov", '{"noticeId": "n1", "type": "o", "active": true, "naicsCode": "11"}'),
        ("ted_eu", '{"ND": "5", "BT-21-Procedure": {"MUL": "Titre"}, "publicationDate": "2026-01-02T00:00"}'),
        ("ted_eu", '{"ND": "6"}'),
        ("nsf_awards", '{"title": "no id"}'),
        ("unknown", '{"id": 1}'),
        ("grants_gov", "not json"),
    ]
    rows = spark.createDataFrame(payloads, "source string, payload string").withColumn("landed_at", F.lit("2026-01-01").cast("timestamp"))
    got = {r["dedupe_key"]: r for r in landed.normalize(rows).collect()}
    assert set(got) == {"simpler_grants::7", "sam_gov::n1", "ted_eu::5", "ted_eu::6"}
    a, b, c, d = (got[k] for k in ("simpler_grants::7", "sam_gov::n1", "ted_eu::5", "ted_eu::6"))
    assert (a["title"], len(a["description"]), a["max_award"], a["eligibility"], a["categories"], a["url"]) == ("Untitled", 600, 1200, ["a", "b"], ["x"], "https://simpler.grants.gov/opportunity/7")
    assert (b["funding_type"], b["status"], b["categories"]) == ("procurement", "active", ["NAICS: 11"])
    assert (c["title"], c["open_date"], d["title"], d["geography"]) == ("Titre", "2026-01-02", "EU Procurement Notice 6", ["European Union"])


def test_status_toggles_alike_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"2026-01-01 00:00:{i % 60:02d}", rng.randrange(3), rng.choice(["opportunity.saved", "opportunity.applied", "bogus"]), str(rng.randrange(3))) for i in range(200)]
    table = spark.createDataFrame(rows, "event_id int, ts string, source_user_id long, event_type string, opp_id string").withColumn("ts", F.to_timestamp("ts"))
    batch = {(r["source_user_id"], r["opp_id"]): r["status"] for r in events.toggled_status(table).collect()}
    table.coalesce(1).write.json(str(tmp_path / "in"))
    query = events.toggled_status_stream(spark.readStream.schema(table.schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("toggles").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    stream = {(r["source_user_id"], r["opp_id"]): r["status"] for r in spark.table("toggles").collect() if r["status"]}
    assert stream == batch


def test_stream_ingest_ends_like_a_batch_upsert(spark, tmp_path):
    rows = [("nsf_awards", f'{{"id": "{i % 7}", "title": "t{i}"}}', f"2026-01-01 00:{i:02d}:00") for i in range(20)]
    table = spark.createDataFrame(rows, "source string, payload string, landed_at string").withColumn("landed_at", F.to_timestamp("landed_at"))
    table.repartition(1).sortWithinPartitions("landed_at").write.json(str(tmp_path / "in"))
    events.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["source_record_id"]: r["title"] for r in KeyedStore(spark, str(tmp_path / "store")).read().collect()}
    assert got == {str(i % 7): f"t{i}" for i in range(20)}


def test_title_scorer_by_hand(spark):
    """`health equity` is in the title (40), both words of `maternal health` are (28): 68, cut to 60. Two cues name nonprofits. One of seven words is generic."""
    pairs = scoring_v5.pairs(opps(spark, {}, {"id": "sg_002", "title": "Community Innovation Support Program", "eligibility": [], "source": "ted_eu"}), orgs(spark, {}))
    got = {r["id"]: r for r in scoring_v5.score_v5(pairs).collect()}
    values = lambda r: tuple(r[d] for d in (*scoring_v5.DIMENSIONS, "total", "confidence"))
    assert values(got["sg_001"]) == (60, 25, 0, 4, 0, 89, "excellent")
    assert got["sg_001"]["reasons"] == ["Org mission phrase in title: health equity", "Org focus area words in title: maternal", "Strong org-type match: nonprofit = intended applicant"] and got["sg_001"]["risks"] == []
    # All four words are generic (20, times 1.4 without a match, at most 20); nobody is meant (7); another continent's source (1).
    assert values(got["sg_002"]) == (0, 7, 0, 1, 20, 0, "weak")
    assert len(got["sg_002"]["risks"]) == 3


def test_stems_phrases_and_siblings():
    assert [scoring_v5.plain_stem(w) for w in ("services", "training", "communities", "workers", "mental", "wind", "education", "business")] == ["servic", "train", "community", "worker", "ment", "wind", "educa", "busi"]
    assert scoring_v5.siblings()["clean energy"] == ["renewable energy", "green energy", "solar energy", "wind energy"]  # the later group's
    assert [scoring_v5.needed(n) for n in (2, 3, 4, 5)] == [2, 3, 3, 4]


def test_stem_column_equals_plain_stem(spark):
    words = ["services", "ties", "applied", "king", "training", "nation", "kindness", "payment", "mental", "metal", "workers", "boxes", "gas", "class", "a", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", scoring_v5.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: scoring_v5.plain_stem(w) for w in words}


def test_interpreter_by_hand(spark):
    change = {"title": "NOFO - Maternal and Child Health Equity Initiative", "description": "Job training for veterans, and youth employment near wind farms.", "eligibility": ["nonprofit"]}
    r = interpretation.interpret(opps(spark, change, {"description": None, "title": "Pre-K wicker arts"})).orderBy("domains").collect()
    by = {x["clean_title"]: x for x in r}
    one, two = by["Maternal and Child Health Equity Initiative"], by["Pre-K wicker arts"]
    # health: 18 (health equity) + 8 (the word maternal); workforce: 20 (job training) + 20 (youth employment); climate: 8 (wind); veterans: 8.
    assert one["domains"] == ["workforce", "health", "climate", "veterans"] and one["subdomains"] == ["workforce_development", "youth_workforce", "health_equity", "maternal_health", "clean_energy", "veteran_services"]
    assert one["populations"] == ["pregnant_people", "youth", "veterans"]
    assert [p["phrase"] for p in one["desc_phrases"]] == ["job training"] and one["generic_terms"] == ["initiative"] and one["domain_confidence"] == 100
    assert one["title_signals"]["strong"] == ["health equity"] and one["title_signals"]["weak"] == ["maternal", "child"]
    # pre-k counts as a word, wic inside a longer one does not.
    assert two["subdomains"] == ["early_childhood", "arts"] and two["description_signals"]["strong"] == [] and two["domain_confidence"] == 100


def test_whole_words(spark):
    row = spark.createDataFrame([("a hiv-positive group, wicker, stem_cell, k12 coding",)], "t string").select(taxonomy.ranked(taxonomy.domain_scores(F.col("t")), 1).alias("s")).first()
    assert row["s"] == ["stem", "sexual_health"]


def test_first_related_pair_of_places_decides(spark):
    rows = [(["greater midwest area", "texas"], ["ohio", "texas"]), (["texas"], ["ohio", "texas"]), (["kenya"], ["ohio"]), (["kenya"], [])]
    got = spark.createDataFrame(rows, "org_places array<string>, places array<string>").select(scoring_v4.geography().alias("g")).collect()
    assert [r["g"] for r in got] == [6, 8, 0, 5]


def test_variants_in_one_pass_equal_single_ones(spark):
    pairs = scoring_v1.pairs(opps(spark, {}, {"id": "b", "geography": ["Kenya"], "max_award": None}), orgs(spark, {}, {"id": "o2", "has_501c3": False}))
    every = {(r["variant"], r["org_id"], r["id"]): r["total"] for r in scoring_v1.score_variants(pairs).collect()}
    for name, (weights, synonyms) in scoring_v1.VARIANTS.items():
        for r in scoring_v1.score_audit(pairs, weights, synonyms).collect():
            assert every[name, r["org_id"], r["id"]] == r["total"]
    assert len(every) == 4 * len(scoring_v1.VARIANTS)
