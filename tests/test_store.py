"""The incremental store on small batches: what it holds, which files it touches, and what happens when a batch comes again or fails."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillrank.operators import keyed_store, store
from quillrank.operators.keyed_store import KeyedStore

SCHEMA = "dedupe_key string, title string, funding_type string, raw_payload string"


def batch(spark, rows):
    return spark.createDataFrame([(k, t, f, t) for k, t, f in rows], SCHEMA)


def content(table):
    return sorted(map(tuple, table.select("dedupe_key", "title", "funding_type").collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path / "data") for f in names if f.endswith(".parquet")}


def test_batches_end_like_one_upsert_after_the_other(spark, tmp_path):
    deal = random.Random(3)
    kept, want = KeyedStore(spark, str(tmp_path), buckets=8), {}
    for n in range(4):
        rows = [(f"k{deal.randint(0, 30)}", f"t{n}-{i:02d}", f"f{n}-{i}") for i in range(20)] + [(None, "lost", "lost")]
        counts = kept.merge(batch(spark, rows), n, F.col("title"))
        known = set(want)
        for k, t, f in rows[:-1]:
            want[k] = (t, want[k][1] if k in want else f)  # the funding type stays as first inserted
        new = len(set(want) - known)
        assert (counts["fetched"], counts["errors"], counts["inserted"], counts["updated"]) == (21, 1, new, 20 - new)
        assert content(kept.read()) == sorted((k, *v) for k, v in want.items())
    assert [tuple(r) for r in kept.history().select("version", "fetched", "errors").collect()] == [(n, 21, 1) for n in range(4)]
    assert content(kept.get("k1", "nobody")) == [("k1", *want["k1"])]


def test_untouched_buckets_keep_their_files_and_old_ones_go(spark, tmp_path):
    kept = KeyedStore(spark, str(tmp_path), buckets=16)
    kept.merge(batch(spark, [(f"k{i}", "a", "f") for i in range(100)]), 0, F.lit(0))
    first = files(tmp_path)
    kept.merge(batch(spark, [("k1", "b", "g")]), 1, F.lit(0))
    assert {f: t for f, t in files(tmp_path).items() if f in first} == first and len(files(tmp_path)) == len(first) + 1
    kept.merge(batch(spark, [("k1", "c", "g")]), 2, F.lit(0))
    assert len(files(tmp_path)) == len(first) + 1  # k1's bucket of version 0 is gone, that of version 1 stays for readers
    assert content(kept.read(1)) == sorted((f"k{i}", "b" if i == 1 else "a", "f") for i in range(100))
    assert content(KeyedStore(spark, str(tmp_path)).read()) == sorted((f"k{i}", "c" if i == 1 else "a", "f") for i in range(100))


def test_a_repeated_batch_changes_nothing_and_a_failed_one_is_written_anew(spark, tmp_path, monkeypatch):
    kept = KeyedStore(spark, str(tmp_path), buckets=4)
    counts = kept.merge(batch(spark, [("a", "1", "x"), ("b", "1", "x")]), 0, F.lit(0))
    before = files(tmp_path)
    assert kept.merge(batch(spark, [("a", "2", "y")]), 0, F.lit(0)) == counts and files(tmp_path) == before
    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost before the commit")))
        with pytest.raises(OSError):
            kept.merge(batch(spark, [("a", "2", "y"), ("c", "2", "y")]), 1, F.lit(0))
    assert content(kept.read()) == [("a", "1", "x"), ("b", "1", "x")] and kept.versions() == [0]
    kept.merge(batch(spark, [("a", "3", "z")]), 1, F.lit(0))
    assert content(kept.read()) == [("a", "3", "x"), ("b", "1", "x")]


def test_empty_batches_null_values_and_an_empty_store(spark, tmp_path):
    kept = KeyedStore(spark, str(tmp_path), buckets=4)
    with pytest.raises(ValueError):
        kept.read()
    assert kept.merge(batch(spark, []), 0, F.lit(0))["fetched"] == 0 and content(kept.read()) == []
    kept.merge(batch(spark, [("a", None, None), (None, "x", "y")]), 1, F.lit(0))
    assert content(kept.read()) == [("a", None, None)]
    assert kept.merge(batch(spark, [(None, "x", "y")]), 2, F.lit(0))["errors"] == 1 and content(kept.read()) == [("a", None, None)]


def test_flags_of_an_upsert(spark):
    old, new = batch(spark, [("a", "1", "x")]), batch(spark, [("a", "2", "y"), ("b", "2", "y"), ("b", "3", "y")])
    got = store.upsert(old, new, "dedupe_key", F.col("title"), flags=True).select("dedupe_key", "_old", "_n").collect()
    assert sorted(map(tuple, got)) == [("a", True, 1), ("b", None, 2)]
    assert keyed_store.KeyedStore.__doc__
