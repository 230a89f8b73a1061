"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import decontamination, fingerprints, langid, lm, neardup, packing, pii, sharding, token_files, urls, words
from quillrank.llm.storage import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 800
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
ROWS = [
    (3, BASE), (1, BASE.replace("omega", "Omega")), (2, BASE + " extra"), (7, None), (8, ""), (9, " \n\t"), (10, LONG), (11, LONG), (12, "one"), (13, "one two"),
    (None, BASE), (14, "Çà et là, l'été s'en va; déjà vu."), (15, "one two"), (15, "one two"), (20, "quick brown fox jumps over the lazy dog"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shingles string, size string, row string, rep string, score string, word string, canonical string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 7) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def plain_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def by_key(t):
    tie = 42 if t[1] is None else xxhash.xxh64(t[1].encode(), seed=42).intdigest()
    return (t[0] is not None, t[0] or 0, tie - (1 << 64) * (tie >> 63), t[1] is not None, t[1] or "")


def test_token_files_round_trip(spark, docs, empty, tokenizer):
    scratch = Scratch(spark, "t3")
    files = scratch.save(token_files.write_token_files(docs, f"{scratch.path}/f", TOKENIZER, 1, length=64))
    got = sorted(token_files.read_token_files(files, f"{scratch.path}/f").collect(), key=lambda r: r["start"])
    at = 0
    for r, (key, text) in zip(got, sorted(ROWS, key=by_key), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(ids), crc(ids))
        at += len(ids)
    name = scratch.path.removeprefix("file://") + "/f/part-000000.ids"
    file = pa.ipc.open_file(pa.memory_map(name))
    ids, mask = token_files.sequence(file, 0)
    assert len(ids) == len(mask) == 64 and file.schema.field("ids").type.list_size == 64
    none = scratch.save(token_files.write_token_files(empty, f"{scratch.path}/e", TOKENIZER, 1))
    assert token_files.read_token_files(none, f"{scratch.path}/e").count() == 0
    scratch.clear()


def test_packing_covers_every_id_once(spark, docs, empty, tokenizer):
    got = packing.pack(docs, TOKENIZER, 2, Scratch(spark, "t5"), longest=256).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and all(r["offset"] == 0 for r in got)
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    for key, text in set(ROWS):
        ids, at, copies = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0, ROWS.count((key, text))
        own = sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["start"])
        for r in own[::copies]:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
            assert sum(o["start"] == at for o in own) == copies
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(empty, TOKENIZER, 2, Scratch(spark, "t5e")).count() == 0


def test_packed_sequences_are_written_with_their_ids(spark, docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 4_000)  # several parts for each length
    scratch = Scratch(spark, "t5w")
    got = packing.pack(docs, TOKENIZER, 2, scratch, longest=256).collect()
    want = Counter()
    for key, text in ROWS:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for n in packing.pieces_of(len(ids), 256):
            want[(key, at, tuple(ids[at : at + n]))] += 1
            at += n
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in got) == want
    order = [(-r["length"], *((r["doc_id"] is not None, r["doc_id"] or 0)), r["start"], r["ids_crc32"]) for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert order == sorted(order) and sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"]) for r in got)
    written = spark.read.parquet(f"{scratch.path}/2-sequences/length=256")
    assert {len(r["ids"]) for r in written.collect()} == {512} and written.select("part").distinct().count() > 1
    scratch.clear()


def test_shards_are_contiguous_and_balanced(spark, docs, empty):
    got = sorted(sharding.assign_shards(docs, 4, Scratch(spark, "t8")).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == [k for k, _ in sorted(ROWS, key=lambda t: (t[0] is not None, t[0] or 0))]
    for shard in {r["shard"] for r in got}:
        assert [r["slot"] for r in got if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in got)))
    own = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == own and all((r["law"], r["grown_shard"]) == ("bytes", None) for r in got)
    total, at = sum(r["size"] for r in got), 0
    for r in got:
        assert r["shard"] == min(3, (2 * at + r["size"]) * 4 // (2 * total))
        at += r["size"]
    even = spark.range(400).selectExpr("id as doc_id", "repeat('a', 84) as text")
    assert [r["count"] for r in sharding.assign_shards(even, 40, Scratch(spark, "t8")).groupBy("shard").count().collect()] == [10] * 40
    assert sharding.assign_shards(empty, 4, Scratch(spark, "t8e")).count() == 0


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    scratch = Scratch(spark, "t6")
    got = neardup.near_duplicates(docs, scratch, percent=80, k=5).collect()
    sets = {}
    for key, text in ROWS:
        w = plain_words(text)
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    keys = [k for k in sets if k is not None]
    up = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    assert len(got) == len(ROWS)
    for r in got:
        want = up.get(r["doc_id"])
        assert r["component_id"] == want and r["kept"] == (want == r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]])
    assert neardup.near_duplicates(empty, scratch).count() == 0


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Copies with several edits each, so that many pairs lie near the threshold and the block path is taken."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(220):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t6h"), percent=85, k=3).collect()
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = [lo if v == hi else v for v in up]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(up))


def test_leaks_equal_brute_force(spark, docs, empty):
    items = [(1, BASE), (2, "one two"), (3, None), (4, ""), (5, "quick brown fox jumps over the lazy dog"), (6, "nothing of the kind is in here at all"), (5, "quick brown fox jumps over the lazy dog")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    more = [(30, "pad pad " + BASE.upper() + " pad"), (31, "the quick brown fox jumped over one lazy dog"), (32, "x " * 700 + BASE + " tail")]
    rows = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(*m, "s") for m in more], "doc_id long, text string, source string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(rows, benchmark).collect()}

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])

    want = set()
    for key, text in ROWS + more:
        w = (text or "").lower().split()
        for item, body in items:
            v = (body or "").lower().split()
            for i in range(len(w) - len(v) + 1) if v else ():
                a, b = shingles(w[i : i + len(v)]), shingles(v)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((key, item))
    assert got == want and (30, 1) in got and (32, 1) in got and (31, 5) not in got
    kept = decontamination.clean_documents(rows, benchmark, Scratch(spark, "t2"))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in ROWS + more} - {k for k, _ in want}
    assert decontamination.find_leaks(empty, benchmark).count() == 0
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_of_edited_items_are_found(spark):
    """Items with words changed, dropped and added, in documents of other words: at least 0.95 of those that brute force finds, and nothing else."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3_000)}"
    items = [[word() for _ in range(rng.choice((3, 5, 8, 15, 22, 40, 59, 120)))] for _ in range(60)]
    rows = []
    for i in range(600):
        own = list(rng.choice(items))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            at = rng.choice((0, len(own) - 1, rng.randrange(len(own)))) if own else 0
            own[at : at + 1] = rng.choice(([word()], [], [own[at], word()])) if own else []
        rows.append((i, " ".join([word() for _ in range(rng.randrange(60))] + own + [word() for _ in range(rng.randrange(60))])))

    def counted(w):
        return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or Counter([tuple(w)])

    bags, want = [counted(v) for v in items], set()
    for key, text in rows:
        w = text.split()
        for j, v in enumerate(items):
            if len(v) < 5 and " ".join(v) in text or set(v) & set(w):
                for at in range(len(w) - len(v) + 1):
                    a = counted(w[at : at + len(v)])
                    if sum((a & bags[j]).values()) >= 0.8 * sum((a | bags[j]).values()):
                        want.add((key, j))
                        break
    benchmark = spark.createDataFrame([(j, " ".join(v)) for j, v in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 300


def test_near_fingerprints_are_all_found():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 11), replace=False)) for _ in range(3_000)]
    marks = prints[rng.integers(0, 300, 3_000)] ^ np.array(flips, np.uint64)
    table = decontamination.Table(prints, np.arange(300), np.zeros(300, np.int64))
    want = {(m, p) for m in range(3_000) for p in np.flatnonzero(np.bitwise_count(marks[m] ^ prints) <= decontamination.RADIUS).tolist()}
    assert set(zip(*(x.tolist() for x in table.near(marks)), strict=True)) == want


def test_clean_documents_judges_each_row_by_itself(spark):
    rows = [(None, "pad " + BASE), (None, "clean text without any item"), (None, None), (None, ""), (1, BASE), (1, "another clean text"), (1, None), (-(1 << 63), "the smallest key"), (2, BASE)]
    benchmark = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    kept = decontamination.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, Scratch(spark, "t2n"))
    assert kept.columns == ["doc_id", "text"]
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if BASE not in (r[1] or ""))


def plain_sketch(text, fraction):
    """The kept hashes and up to where they are all there, one shingle at a time."""
    w = plain_words(text)
    runs = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    own = {int(words.row_shingles(pa.array([" ".join(r)]), 5)[0][0]) for r in runs}
    assert len(own) == len(runs)
    top = fraction * 2**64
    kept = set(sorted(own)[: fingerprints.LEAST]) | {h for h in own if h <= top}
    return kept, 2.0**64 if len(kept) < fingerprints.LEAST else max(top, max(kept))


def plain_likeness(a, b):
    x, y = ({h for h in s[0] if h <= min(a[1], b[1])} for s in (a, b))
    return len(x & y) / max(1, min(len(x), len(y))) if a[0] and b[0] else float(bool(a[0]) == bool(b[0]))


def test_fingerprints_equal_brute_force(spark, empty):
    rows = [*ROWS, (None, "another row without a key"), (None, LONG), (None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _guest string")
    hexed = lambda s: "".join(f"{h:016x}" for h in sorted(s))
    tie = lambda t: by_key((0, t))[2:]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], tie(r[1]))) + sorted((r for r in rows if r[0] is None), key=lambda r: tie(r[1]))
    for parts in (1, 3, 8):
        got = fingerprints.compare_with_next(table, parts, fraction=0.5).collect()
        left = Counter()
        for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            text, after = text or "", after or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            a, b, c = (plain_sketch(t, 0.5) for t in (text, edited, after))
            left[(key, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a[0]), hexed(b[0]), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9))] += 1
        assert left == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    plain = Counter((r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint(table, fraction=0.5).collect())
    assert plain == Counter((r["doc_id"], r["fingerprint"]) for r in got)
    assert fingerprints.compare_with_next(empty, 3).count() == 0


def test_merged_sketches_are_those_of_the_whole(spark, empty):
    import random

    rng = random.Random(8)
    drawn = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = [("big" if i % 3 else None, drawn(n)) for i, n in enumerate([3, 40, 200, 90, 700, 12, 260, 30, 0] * 3)]
    parts = fingerprints.fingerprint(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    named = parts.join(spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "doc_id long, site string"), "doc_id")
    got = {r["site"]: r for r in fingerprints.merge_by(named, "site").collect()}
    for site in ("big", None):
        every = set().union(*(set(words.row_shingles(pa.array([t]), 5)[0].tolist()) for k, t in rows if k == site))
        kept = sorted({h for h in every if h <= fingerprints.FRACTION * 2**64}.union(sorted(every)[: fingerprints.LEAST]))
        assert got[site]["fingerprint"] == "".join(f"{h:016x}" for h in kept)
    one, two, both = fingerprints.sketches(pa.array([rows[1][1], rows[2][1], rows[1][1]]))
    assert fingerprints.merge(one, both).tolist() == one.tolist()
    whole = fingerprints.read(got["big"]["fingerprint"])
    assert fingerprints.containment(one, whole) == 1.0 and fingerprints.containment(whole, one) < 0.1 and fingerprints.containment(one, two) == 0.0
    assert fingerprints.merge_by(fingerprints.fingerprint(empty), "doc_id").count() == 0


def test_sketches_at_the_registered_settings_against_exact_containment(spark):
    import random

    rng = random.Random(3)
    drawn = lambda n: " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))
    rows = [(i, drawn(n)) for i, n in enumerate([20, 30, 50] * 40 + [700, 3_000] * 5)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}

    def exact(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(x & y) / min(len(x), len(y)), max(len(x), len(y))

    order = sorted(rows, reverse=True)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want, n = exact(text, text[: len(text) - len(text) // 2] + after[: len(text) // 2])
        assert got[key]["near_edited"] == pytest.approx(want, abs=0 if n < fingerprints.LEAST else 0.2)
    assert sum(len(r["fingerprint"]) for r in got.values()) < sum(len(t) for _, t in rows) * 2
    short, long = rows[1][1], rows[-1][1]
    one, other, whole = fingerprints.sketches(pa.array([short, long, f"{long} {short}"]))
    assert fingerprints.likeness(one, whole) == 1.0 and fingerprints.likeness(other, whole) == 1.0 and fingerprints.likeness(one, other) == 0.0
    # a text of one word or few beside one of 20,000: always a number, and never more than there is
    huge = drawn(20_000)
    for small, want in (("w1", 0.0), ("w1 w2 w3 w4 w5", 0.0), (" ".join(huge.split()[:5]), None), (" ".join(huge.split()[:60]), 1.0), (huge, 1.0), ("", 0.0)):
        a, b = fingerprints.sketches(pa.array([small, huge]))
        for got_ in (fingerprints.likeness(a, b), fingerprints.likeness(b, a)):
            assert 0.0 <= got_ <= 1.0 and (want is None or got_ == want)


PII = [
    ("mail me at a.b+c@mail-1.example.org, or x@y.zz_q@w.vv now", ["email", "email", "email"]),
    ("card 4111 1111 1111 1111 and 4111-1111-1111-1112", ["card"]),
    ("call +1 (017) 555-7713 today, ip 10.0.0.1 not 300.1.1.1", ["ip", "phone"]),
    ("pay to IBAN DE89 3704 0044 0532 0130 00 please", ["iban"]),
    ("pay to DE89 3704 0044 0532 0130 01 please", []),
    ("phone: 555-123-4567", ["tel"]),
    ("part 555-123-4567", []),
    ("social security 123-45-6789", ["ssn"]),
    ("nothing é here 12", []),
    ("a" * 200_000, []),
    ("1 " * 30_000, []),
    ("12, " * 100_000 + "call 555-123-4567", ["tel"]),
    ("é12; " * 60_000 + "x" * 999 + " é@b.cc +1 234 567 8901 " + "a@b.cc " * 3_000, ["email"] * 3_000 + ["phone"]),
    ("visit 555-123-4567@x.com phone 555-123-4567", ["email", "tel"]),
    (None, []),
    ("", []),
]


def test_pii_spans_and_redaction(spark, empty):
    rows = spark.createDataFrame([(i, t, "x", "b", "p") for i, (t, _) in enumerate(PII)], "doc_id long, text string, pii string, _base string, _pieces string")
    found = pii.find_pii(rows)
    assert found.columns == ["doc_id", "text", "_base", "_pieces", "pii"]
    shapes = {"email": r".+@.+", "ip": r"[0-9.]+", "card": r"[0-9 -]+", "phone": r"\+.*[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+", "tel": r"\(?[0-9]{3}\)?.[0-9]{3}.[0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
    got = {r["doc_id"]: r for r in found.collect()}
    for i, (text, kinds) in enumerate(PII):
        assert [s["kind"] for s in got[i]["pii"]] == kinds and (got[i]["_base"], got[i]["_pieces"]) == ("b", "p"), (text or "")[:80]
        for s in got[i]["pii"]:
            assert re.fullmatch(shapes[s["kind"]], text[s["start"] : s["end"]])
    named = {t: i for i, (t, _) in enumerate(PII)}
    assert [(s["start"], s["end"]) for s in got[named["pay to IBAN DE89 3704 0044 0532 0130 00 please"]]["pii"]] == [(12, 39)]
    assert [(s["start"], s["end"], s["score"]) for s in got[named["phone: 555-123-4567"]]["pii"]] == [(7, 19, 0.7)]
    assert [(s["start"], s["end"]) for s in got[named["social security 123-45-6789"]]["pii"]] == [(16, 27)]
    plain = pii.redact(found)
    assert plain.columns == found.columns
    clean = {r["doc_id"]: r["text"] for r in plain.collect()}
    for i, (text, _) in enumerate(PII):
        if text is None:
            assert clean[i] is None
            continue
        want, at = "", 0
        for s in sorted(got[i]["pii"], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                want += text[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert clean[i] == want + text[at:]
    assert clean[0] == "mail me at <EMAIL>, or <EMAIL><EMAIL> now" and clean[2] == "call <PHONE> today, ip <IP> not 300.1.1.1"
    assert pii.find_pii(empty).count() == 0


def test_pii_takes_time_in_proportion_to_the_text(spark):
    import time

    rows = spark.createDataFrame([(1, "é " + "17, " * 400_000), (2, "+1 234 567 890; " * 60_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in pii.redact(pii.find_pii(rows)).selectExpr("doc_id", "size(pii) as n", "length(text)").collect()}
    assert got == {1: 0, 2: 60_000} and time.time() - began < 60


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "https://WWW.Example.com/en/7x?utm_source=a"), (2, "http://a.example.com/en/8"), (3, "ftp://x.net/de/81#q"), (4, None), (5, "no scheme"), (6, "http://bad.io/p/?b=2&ref=1&a=1"), (7, "http://m.bad.io:80/p?a=1&b=2"), (7, "http://m.bad.io:80/p?a=1&b=2"), (8, "http://good.io"), (9, "http://notcom/en/")],
        "page_id long, url string",
    ).selectExpr("*", "'x' as host", "'y' as rule", "'z' as canonical", "1 as block", "2 as word")
    listed = spark.createDataFrame([("bad.io/p?a=1&b=2",), ("bad.io/p?a=1&b=2",), (None,)], "canonical string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, listed).collect() if r["page_id"] not in (4, 5))
    assert got == Counter(
        [(1, "www.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "a.example.com", "/en/8", "com/en/", "block"), (3, "x.net", "/de/81", "net/de/", "allow"), (6, "bad.io", "/p/", None, "block"),
         (7, "m.bad.io:80", "/p", None, "block"), (7, "m.bad.io:80", "/p", None, "block"), (8, "good.io", "", None, "allow"), (9, "notcom", "/en/", None, "allow")]
    )
    long = spark.createDataFrame([(1, "https://x.io/" + "a" * 1_000_000 + "/?q"), (None, "https://x.io/b")], "page_id long, url string")
    far = urls.judge(long, spark.createDataFrame([("x.io/" + "a" * 1_000_000 + "?q",)], "canonical string"))
    assert {(r["page_id"], r["verdict"], len(r["path"])) for r in far.collect()} == {(1, "block", 1_000_002), (None, "allow", 2)}
    assert urls.judge(pages.limit(0), listed).count() == 0 and urls.judge(pages, listed).columns == ["page_id", "host", "path", "rule", "verdict"]
    rest = [r for r in urls.judge(pages, listed.limit(0)).collect() if r["page_id"] in (4, 5)]
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rest] == [("", "", None, "allow")] * 2
    many = spark.range(20_000).selectExpr("concat('h', id, '.io/') as canonical")
    marked = urls.mark_listed(many, many.where("canonical like 'h1%'"))
    assert marked.where("listed").count() == many.where("canonical like 'h1%'").count() and marked.count() == 20_000


def test_language_of_mixtures_and_empty_models(spark, empty):
    en, fr = "the house and the garden with some of those things that were there", "la maison et le jardin avec quelques choses qui étaient là depuis"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(200)]
    extra = [(900, f"{en} {en} {en} {fr} {fr} {fr}", None), (901, None, "en"), (902, "123 456", "fr"), (903, "", None), (None, en, "en")]
    table = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify_by_own_labels(table).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert {x["lang"] for x in got[900]["languages"]} == {"en", "fr"} and 0.4 < got[900]["score"] < 0.65
    assert [got[i]["lang_pred"] for i in (901, 902, 903)] == ["und"] * 3 and got[901]["score"] == 0.0
    assert langid.identify_by_own_labels(empty).count() == 0
    assert langid.identify(table, langid.Model([], langid.np.zeros((langid.BUCKETS, 0)))).where("lang_pred <> 'und'").count() == 0
    unlabelled = langid.identify_by_own_labels(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    odd = spark.createDataFrame([(1, "½ ² Ⅷ ① 7", "en", "a"), (2, "ж", "en", "b"), (2, "ж", "en", "b"), (3, "la maison " * 200_000, None, "c")], "doc_id long, text string, lang string, _found string")
    model = langid.train(table.where("lang is not null and text is not null").select("text", "lang"))
    found = langid.identify(odd, model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == 4 and found.columns == ["doc_id", "text", "lang", "_found", "lang_pred", "score", "languages"]
    assert got[1]["lang_pred"] == "und" and got[2]["lang_pred"] != "und" and got[3]["lang_pred"] == "fr" and got[3]["_found"] == "c"
    tied = langid.Model(["aa", "bb"], np.ones((langid.BUCKETS, 2)))
    assert langid.identify(odd.where("doc_id = 2"), tied).first()["lang_pred"] == "aa"
    with pytest.raises(ValueError):
        langid.train(table.where("lang is not null").select("text", "lang"), most_languages=1)


def test_mixture_inference_equals_plain_expectation_maximisation():
    """Shares of every set of languages by plain loops over n-grams, and the set of the best penalised likelihood."""
    rng = np.random.default_rng(6)
    texts = ["the house and the garden ", "la maison et le jardin ", "das haus und der garten ", "huis en de tuin "]
    counts = np.zeros((langid.BUCKETS, 4))
    for j, t in enumerate(texts):
        np.add.at(counts[:, j], langid.grams(np.frombuffer((t * 50).encode(), np.uint8)), 1)
    model = langid.Model(["de", "en", "fr", "nl"], counts)
    p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * langid.BUCKETS)

    def shares(found, langs):
        w = [1 / len(langs)] * len(langs)
        for _ in range(60):
            new = [0.0] * len(langs)
            for g in found:
                mass = [w[i] * p[g, lang] for i, lang in enumerate(langs)]
                for i, m in enumerate(mass):
                    new[i] += m / sum(mass) / len(found)
            w = new
        return w, sum(math.log(sum(w[i] * p[g, lang] for i, lang in enumerate(langs))) for g in found)

    for case in ([0], [3], [0, 1], [1, 2, 3], [0, 1, 2, 3]):
        data = "".join(texts[i] * int(rng.integers(4, 8)) for i in case).encode()
        found = langid.grams(np.frombuffer(data, np.uint8)).tolist()
        best = max((sub for k in range(1, 5) for sub in itertools.combinations(range(4), k)), key=lambda sub: shares(found, sub)[1] - 1.5 * math.log(len(found)) * (len(sub) - 1))
        want = dict(zip([model.langs[i] for i in best], shares(found, best)[0], strict=True))
        got = dict(model.mixture(np.frombuffer(data, np.uint8)))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=0.03) for k in want), case


def test_languages_of_held_out_documents(spark):
    """Accuracy on the fold that nothing is learned from, for labelled documents of the test tables."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables absent")
    got = langid.identify_by_own_labels(spark.read.parquet(path)).where("held_out and lang is not null and lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_token_file_of_a_repeated_attempt_replaces_the_first(spark, docs, tmp_path):
    """On a file system that doesn't rename onto a file; and a failing attempt leaves no file."""
    local = token_files.pyarrow.fs.LocalFileSystem()

    class Strict:
        get_file_info, delete_file = local.get_file_info, local.delete_file

        @staticmethod
        def move(own, name):
            if os.path.exists(name):
                raise OSError("exists")
            local.move(own, name)

    (tmp_path / "a").write_text("one")
    token_files.settle(Strict, f"{tmp_path}/a", f"{tmp_path}/part")
    (tmp_path / "b").write_text("two")
    token_files.settle(Strict, f"{tmp_path}/b", f"{tmp_path}/part")
    assert (tmp_path / "part").read_text() == "two" and not (tmp_path / "b").exists()
    with pytest.raises(OSError):
        token_files.settle(Strict, f"{tmp_path}/gone", f"{tmp_path}/other")

    folder = tmp_path / "files"
    with pytest.raises(Exception, match="range"):  # rows of no ids fail once the attempt's file is open
        token_files.write_token_files(docs, folder.as_uri(), TOKENIZER, 1, length=0).collect()
    assert os.listdir(folder) == []


def test_lm_base_scores_and_proper_probabilities(spark, docs, empty, monkeypatch):
    scratch = Scratch(spark, "t1")
    own = docs.where(~lm.held_out())
    vocabulary = scratch.save(lm.count_words(own))
    model = lm.train(own, vocabulary)
    want = Counter()
    for key, text in ROWS:
        if zlib.crc32(("" if key is None else str(key)).encode()) % 10:
            want.update([*plain_words(text), None])
    n, v = sum(want.values()), len(want)

    def check(most):
        monkeypatch.setattr(lm, "MOST_KNOWN", most)
        got = lm.score(docs, model, vocabulary, scratch).collect()
        assert len(got) == len(ROWS)
        left = Counter((k, len(plain_words(t)) + 1) for k, t in ROWS)
        for r in got:
            text = next(t for k, t in ROWS if k == r["doc_id"])
            w = [*plain_words(text), None]
            base = sum(math.log10((want[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(want[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
            left[(r["doc_id"], len(w))] -= 1
        assert not any(left.values())
        return sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got)

    assert check(1_000_000) == check(3)  # broadcast words and joined words score alike
    shares = lm.np.exp(model.log_share.astype(float))
    assert shares.sum() == pytest.approx(1, abs=1e-5) and (model.unknown * shares).sum() == pytest.approx(1, abs=1e-5)
    none = lm.count_words(empty)
    assert lm.score(docs, lm.train(empty, none), none, scratch).where("base_score <> 0").count() == 0
    assert lm.score(empty, model, vocabulary, scratch).count() == 0


def test_lm_scores_equal_plain_loops_and_sum_to_one(spark, docs):
    """Scores anew from the weights, word by word, and the probabilities of all words after a history."""
    scratch = Scratch(spark, "t1p")
    own = docs.where(~lm.held_out())
    vocabulary = scratch.save(lm.count_words(own))
    model = lm.train(own, vocabulary)
    known = {int(r["word"]) % 2**64: (int(r["ending"]), r["c"]) for r in vocabulary.collect()}
    assert abs(model.weights).max() > 0
    shift = 65 - len(model.weights).bit_length()

    def softmax(j, keys, prior):
        z = [float(x) for x in prior]
        for n, key in enumerate(keys):
            bucket = int(lm.words.mix(lm.np.array([(key + j + n) % 2**64], lm.np.uint64))[0]) >> shift
            z = [a + float(b) for a, b in zip(z, model.weights[bucket], strict=True)]
        e = [math.exp(x) for x in z]
        return [x / sum(e) for x in e]

    def after(before):
        """Probability of a known word (its code, or None for the unknown one) after the words before it."""
        one, two = (before[-n] if len(before) >= n else int(lm._NONE) for n in (1, 2))
        pair = (one * 0x9FB21C651E98DF25 + two) % 2**64
        classes = softmax(1, (one, pair, two), model.log_share)

        def probability(word):
            if word not in known:
                return 0.1 / model.total * sum(p * float(u) for p, u in zip(classes, model.unknown, strict=True))
            ending, c = known[word]
            label, group = int(model.classes[ending]), (word >> 20) % lm.GROUPS
            mark = (label + 1) * 0x9E3779B97F4A7C15
            groups = softmax(4, (one + mark, pair + mark), model.log_groups[label])
            return (c + 0.1) / model.total * classes[label] / math.exp(model.log_share[label]) * groups[group] / math.exp(model.log_groups[label][group])

        return probability

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs, model, vocabulary, scratch).collect()}
    seen = 0
    for key, text in ROWS:
        if len(plain_words(text)) > 60:
            continue
        codes = [int(w) for w in lm._tokens(lm.pa.array([text or ""]))[0]]
        score = sum(math.log10(after(codes[:i])(w)) for i, w in enumerate(codes))
        assert got[key, len(codes)] == pytest.approx(score, rel=1e-4, abs=1e-4)
        seen += 1
        for i in (0, len(codes) // 2, len(codes) - 1):
            follows = after(codes[:i])
            assert sum(follows(w) for w in known) + follows(None) == pytest.approx(1, abs=1e-3)
    assert seen > 3


def test_lm_scores_held_out_texts_above_their_base(spark):
    """The history tells of the next word: texts of a chain over 60 words, of which each is mostly followed by one of two."""
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def text():
        out = [rng.choice(vocabulary)]
        for _ in range(80):
            out.append(rng.choice(after[out[-1]] if rng.random() < 0.9 else vocabulary))
        return " ".join(out)

    rows = spark.createDataFrame([(i, text()) for i in range(1_500)], "doc_id long, text string")
    scratch = Scratch(spark, "t1h")
    own = rows.where(~lm.held_out())
    vocabulary_ = scratch.save(lm.count_words(own))
    got = lm.score(rows.where(lm.held_out()), lm.train(own, vocabulary_), vocabulary_, scratch).collect()
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in got]
    assert len(got) > 100 and min(gain) > 0 and sum(gain) / len(gain) > 0.4


def test_words_that_collide_under_a_linear_hash(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64; here they are words apart in every operator."""
    one = "a"
    for _ in range(10):
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    rows = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other}"), (4, one)], "doc_id long, text string")
    scratch = Scratch(spark, "tc")
    assert lm.count_words(rows).count() == 3  # the two words and the end
    assert decontamination.find_leaks(rows, spark.createDataFrame([(1, one)], "item_id long, text string")).where("doc_id = 2").count() == 0
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    want = {k: [*plain.encode(t, add_special_tokens=False).ids, 1] for k, t in ((1, one), (2, other), (3, f"{one} {other}"))}
    files = scratch.save(token_files.write_token_files(rows, f"{scratch.path}/f", TOKENIZER, 1))
    assert all(r["ids_crc32"] == crc(want[r["doc_id"]]) for r in token_files.read_token_files(files, f"{scratch.path}/f").collect() if r["doc_id"] != 4)
    packed = packing.pack(rows.where("doc_id < 4"), TOKENIZER, 1, scratch).collect()
    assert all(r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in packed)
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows, scratch, percent=85, k=3).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 1}
    marks = fingerprints.sketches(pa.array([one, other]))
    assert fingerprints.likeness(*marks) == 0.0
