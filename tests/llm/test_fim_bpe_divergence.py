"""Operators 11 to 13 on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import byte_bpe, divergence, fim
from quillrank.llm.storage import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "Lorem ipsum, dolor's sit 12 amet…\n\tconsectetur  adipiscing élit " * 900
WORDS = "eins zwei drei vier fünf one two three four five un deux trois x y".split()


def rows():
    deal = random.Random(5)
    made = [(i, " ".join(deal.choices(WORDS, k=deal.randint(0, 40))), deal.choice(["a", "b", None]), deal.choice(["s", "t", "u", None])) for i in range(100, 220)]
    return [
        (1, "The quick  brown fox\n"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "Çà et là, l'été s'en va; \U0001f600 naïve"), (7, "one"), (7, "one"), (7, "two words"), (None, "no key here"), (None, None),
        (8, "a <P> mark"), (9, "x<S>"), (10, "z" * 3000), (11, "tab\tsep\x0bvt\x0cff\r\ncrlf  "), (12, " 　blank wide"), (13, "don't I'LL we've 3²½ ٣٤"), (14, "\x00\x1c nul"),
    ], made


SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, chunk long, word string, ids string, term string, at long"


@pytest.fixture(scope="module")
def table():
    few, made = rows()
    return [(*r, "en", "s") if len(r) == 2 else r for r in few + made]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([(*r, 1, "f", 2, "w", "i", "t", 3) for r in table], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cut_by_hand(key, text, seed=42):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return key, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_wavelet_ranks_and_places():
    codes = np.random.default_rng(1).integers(0, 8, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(codes, 3)
    at = np.arange(1001)
    for c in range(8):
        assert (matrix.rank(c, at) == np.concatenate([[0], np.cumsum(codes == c)])).all()
    among = np.concatenate([[0], np.cumsum(np.isin(codes, [1, 6]))])
    assert (matrix.count([1, 6], at) == among).all()
    k = np.arange(1, among[-1] + 1)
    found = matrix.place([1, 6], k, np.zeros_like(k), np.full_like(k, 1000))
    assert (found == np.searchsorted(among, k)).all()
    assert matrix.place([1, 6], np.array([5000]), np.array([3]), np.array([9])).tolist() == [9]


def test_fill_in_middle_by_hand(docs, table, empty):
    got = fim.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
    want = sorted((cut_by_hand(r[0], r[1]) for r in table), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted(r["back"] for r in got) == sorted(r[1] or "" for r in table)
    always = fim.fill_in_middle(docs, seed=7, percent=100, suffix_first=0).collect()
    assert {r["form"] for r in always if r["output"] and "mark" not in r["output"] and "x<S>" != r["output"]} == {"psm"}
    assert fim.fill_in_middle(empty).count() == 0


def test_byte_bpe_equals_the_library(spark, docs, table, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, Scratch(spark, "t12")).cache()
    want = [(k, plain.encode_ordinary(t or "")) for k, t, *_ in table]
    ids_of = lambda raw: [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
    assert sorted(((r["doc_id"], ids_of(r["ids"])) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert Counter((r["n_tokens"], r["ids_sha256"]) for r in got.collect()) == Counter((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for _, i in want)
    back = byte_bpe.decode(got, byte_bpe.token_table(spark, RANKS), ["doc_id", "n_tokens"]).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode(), r["n_tokens"]) for r in back) == Counter((k, t or "", len(plain.encode_ordinary(t or ""))) for k, t, *_ in table)
    trip = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, Scratch(spark, "t12r")).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode(), r["n_tokens"]) for r in trip) == Counter((k, t or "", len(plain.encode_ordinary(t or ""))) for k, t, *_ in table)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN, Scratch(spark, "t12e")).count() == 0


def test_byte_bpe_in_many_chunks(spark, docs):
    parts = docs.repartition(7)
    want = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, Scratch(spark, "t12a")).select("doc_id", "ids_sha256")
    got = byte_bpe.encode(parts, RANKS, public_tokenizers.PATTERN, Scratch(spark, "t12b")).select("doc_id", "ids_sha256")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_decode_of_unknown_null_and_no_ids(spark):
    tokens = spark.createDataFrame([(0, b"ab"), (1, b""), (2, b"\xc3")], "id int, bytes binary")
    pack = lambda ids: None if ids is None else b"".join(i.to_bytes(4, "little") for i in ids)
    given = [(1, pack([0, 2, 0])), (2, None), (3, b""), (4, pack([0, 9])), (5, pack([0, 2**32 - 1])), (6, pack([1])), (7, pack([2] * 300_000))]
    got = {r["k"]: r["decoded"] and bytes(r["decoded"]) for r in byte_bpe.decode(spark.createDataFrame(given, "k long, ids binary"), tokens, ["k"]).collect()}
    assert got[1] == b"ab\xc3ab" and got[7] == b"\xc3" * 300_000
    assert [got[i] for i in (2, 3, 6)] == [b"", b"", b""] and got[4] is None and got[5] is None
    assert byte_bpe.decode(spark.createDataFrame([], "k long, ids binary"), tokens, ["k"]).count() == 0


def audit_by_hand(table, least=10, top=10):
    find = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall
    groups, docs, n = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in table:
        lang, source = lang or "", source or ""
        terms = find((text or "").translate({i: i + 32 for i in range(65, 91)}))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in (*sources, None)}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in (*sources, None)}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], p[None][t]), t) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def test_divergence_by_hand(spark, docs, table, empty):
    got = sorted(map(tuple, divergence.audit(docs, Scratch(spark, "t13")).collect()))
    assert got == audit_by_hand(table) and {r[2] for r in got} == {"pair", "term"}
    rare = sorted(map(tuple, divergence.audit(docs, Scratch(spark, "t13r"), least_docs=1, top=3).collect()))
    assert rare == audit_by_hand(table, 1, 3)
    none = divergence.audit(docs, Scratch(spark, "t13n"), least_docs=10_000).collect()
    assert sorted(map(tuple, none)) == audit_by_hand(table, 10_000)
    assert {r["value"] for r in none} == {0} and {r["part"] for r in none} == {"pair"}
    assert divergence.audit(empty, Scratch(spark, "t13e")).count() == 0


def test_divergence_in_small_blocks_and_many_stretches(spark, docs, table, monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 4)
    got = divergence.audit(docs, Scratch(spark, "t13s"), least_docs=2)
    assert sorted(map(tuple, got.collect())) == audit_by_hand(table, 2)


def test_blocks_give_every_joint_table(monkeypatch):
    deal = np.random.default_rng(3)
    levels = deal.poisson(3, (500, 6)) * deal.integers(0, 2, (500, 6))
    term, group = np.nonzero(levels)
    want = Counter((g, a, h, b) for row in levels[levels.any(1)] for g, a in enumerate(row) for h, b in enumerate(row))
    number = np.cumsum(levels.any(1)) - 1
    for columns in (1024, 16):
        monkeypatch.setattr(divergence, "_COLUMNS", columns)
        got = Counter()
        for cells in divergence.Blocks(number[term], group, levels[term, group], 6):
            for g, a, h, b, n in zip(*(c.tolist() for c in cells), strict=True):
                got[g, a, h, b] += n
        assert got == want


def test_terms_that_share_a_hash_stay_apart(docs, monkeypatch):
    monkeypatch.setattr(divergence.words, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abc ABC x abd", np.uint8)
    code, first = divergence._distinct(data, np.array([0, 4, 8, 10]), np.array([3, 7, 9, 13]))
    assert code.tolist() == [0, 0, 1, 2] and first.tolist() == [0, 2, 3]
    assert docs.where(F.col("text").isNull()).count() >= 2
