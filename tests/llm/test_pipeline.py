"""The pipeline against a plain version of its filters, and the registered queries against their SQL."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from quillrank.llm import packing, queries
from quillrank.llm.registry import oracle_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    low = {k: shingles("".join(c.lower() if c.isascii() else c for c in t)) for k, t in texts.items()}
    keys = sorted(low)
    up = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and 100 * len(low[a] & low[b]) >= 80 * len(low[a] | low[b]) and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    kept = {k for k in keys if up[k] == k}
    holds = lambda w, v: any(w[i : i + len(v)] == v for i in range(len(w) - len(v) + 1))
    leaked = {k for k in kept if any(holds(texts[k].lower().split(), v) for v in items)}

    now, seen = docs, []
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        seen.append((name, now))
        if name != "pack":
            assert now.columns == list(pipeline.COLUMNS)
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen}
    assert ids["language"] == set(keys)  # all have letters and one main language
    assert ids["near_dedup"] == kept
    assert ids["decontaminate"] <= kept - leaked and len(ids["decontaminate"]) >= len(kept - leaked) - 1
    assert ids["redact"] == ids["decontaminate"] == ids["pack"]
    assert seen[3][1].where("text rlike '@mail[0-9]'").count() == 0
    assert pipeline.run(spark, SF).count() == seen[4][1].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _found string, _pieces string, kept string, pii string, digest string"
EN, FR = "the quiet house near the old garden wall", "la vieille maison près du jardin de la ville"
OWN = ["harbor", "lantern", "meadow", "copper", "winter", "silver", "thunder", "pebble", "orchard", "violet", "timber", "saddle", "marble", "candle", "falcon", "ribbon", "walnut", "hollow", "breeze", "anchor"]


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", len(t) if t is not None else None, *["x"] * 6) for k, t, lang in rows], SCHEMA)


def texts(df):
    assert df.columns == list(pipeline.COLUMNS)
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def english(i, n=30):
    """A text of its own, by arithmetic on i, that reads like the English ones."""
    return " ".join(f"{EN.split()[(i * 7 + j) % 8]} {OWN[(i * 13 + j * j + i * j) % 20]}" for j in range(n))


def test_language_stage(spark):
    labelled = [(i, f"{EN} {i}" if i % 2 else f"{FR} {i}", "en" if i % 2 else "fr") for i in range(100)]
    extra = [(200, None, "en"), (201, "", None), (202, "12 ½ 34", "fr"), (203, EN, None), (None, EN, "en"), (None, None, None), (204, FR, "fr"), (204, FR, "fr"), (205, (EN + " ") * 5_000, None)]
    found = pipeline.language(spark, rows_of(spark, labelled + extra), "")
    want = Counter((k, t) for k, t, _ in labelled + extra if t and any(map(str.isalpha, t)))
    assert texts(found) == want
    assert {r["doc_id"]: r["lang"] for r in found.collect()}[203] == "en"
    assert pipeline.language(spark, rows_of(spark, [(1, EN, None)]), "").count() == 0
    assert texts(pipeline.language(spark, rows_of(spark, []), "")) == Counter()


def test_near_dedup_stage(spark):
    a, b = english(1), english(2)
    near = a.replace("harbor", "harbour", 1) if "harbor" in a else a + " end"
    rows = [(5, a, "en"), (3, a, "en"), (9, near, "en"), (7, b, "en"), (7, b, "en"), (8, None, "en"), (8, "", "en"), (11, None, None), (None, a, "en"), (None, a, "en"), (None, None, None)]
    got = texts(pipeline.near_dedup(spark, rows_of(spark, rows), ""))
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    five = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    assert alike(five(a), five(near)) and not alike(five(a), five(b))
    assert got == Counter([(3, a), (7, b), (8, None), (8, ""), (11, None), (None, a), (None, a), (None, None)])
    assert texts(pipeline.near_dedup(spark, rows_of(spark, []), "")) == Counter()


def test_decontaminate_and_redact_stages(spark, tmp_path):
    item = english(3, 15)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before {item.upper()} after", "en"), (1, "clean", "en"), (2, None, None), (3, "", "en"), (None, item, "en"), (None, "clean", "en"), (4, english(4), "en"), (4, english(4), "en"), (5, "pad " * 30_000 + item, "en")]
    assert texts(pipeline.decontaminate(spark, rows_of(spark, rows), str(tmp_path))) == Counter((k, t) for k, t, _ in rows if item not in (t or "").lower())
    assert texts(pipeline.decontaminate(spark, rows_of(spark, []), str(tmp_path))) == Counter()
    rows = [(1, "write to a@b.org now", "en"), (1, "write to a@b.org now", "en"), (2, None, None), (None, "", None), (3, "x" * 100_000 + " 10.0.0.1", "en")]
    got = pipeline.redact(spark, rows_of(spark, rows), "")
    assert texts(got) == Counter([(1, "write to <EMAIL> now"), (1, "write to <EMAIL> now"), (2, None), (None, ""), (3, "x" * 100_000 + " <IP>")])
    assert {(r["doc_id"], r["n_chars"]) for r in got.collect()} == {(1, 20), (2, None), (None, 0), (3, 100_005)}
    assert texts(pipeline.redact(spark, rows_of(spark, []), "")) == Counter()


def test_run_equals_a_plain_version(spark, tmp_path):
    """All five stages on one small corpus, down to the ids of every packed sequence."""
    from tokenizers import Tokenizer

    import public_tokenizers

    base = [english(i, 20 + i % 9) for i in range(60)]
    item = " ".join(base[7].split()[3:25])
    rows = [(i, t, "en") for i, t in enumerate(base)] + [(100 + i, f"{FR} {' '.join(OWN[i % 20 :])} {FR} numéro {i}", "fr") for i in range(30)]
    rows += [(300, base[4], None), (301, base[5] + " tail", "en"), (302, "99 100", "en"), (303, None, "en"), (304, f"{base[9]} mail me@x.org", "en"), (305, f"lead {item} {english(77)}", "en")]
    documents = spark.createDataFrame([(k, t, lang, "s", len(t) if t is not None else None) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    live = {k: t for k, t, _ in rows if t and any(map(str.isalpha, t))}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    up, sets = {k: k for k in live}, {k: shingles(t) for k, t in live.items()}
    for a in live:
        for b in live:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    kept = {k: t for k, t in live.items() if up[k] == k and item not in t}
    plain = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    want = Counter()
    for k, t in kept.items():
        ids, at = [*plain.encode(re.sub(r"me@x\.org", "<EMAIL>", t), add_special_tokens=False).ids, pipeline.END_ID], 0
        for n in packing.pieces_of(len(ids), 4096):
            want[(k, at, tuple(ids[at : at + n]))] += 1
            at += n
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in got) == want
    assert 7 not in kept and 300 not in kept and 301 not in kept and 302 not in kept and 305 not in kept


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
