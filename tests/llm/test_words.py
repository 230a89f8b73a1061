"""The hashing kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import groups, neardup, packing, superminhash, tokens, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b🙂.,-'", max_size=40)), min_size=1, max_size=8)


def plain_words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_plain_python(texts):
    data, at = words.utf8(pa.array(texts, pa.string()))
    starts, ends, before = words.split(data, at)
    hashes = words.hashes(data, starts, ends)
    plain = [plain_words(t) for t in texts]
    assert np.diff(before).tolist() == [len(w) for w in plain]
    flat = [w for p in plain for w in p]
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat)}) == len(set(flat)) == len(set(hashes.tolist()))
    for k in (1, 3, 5):
        found, edge = words.row_shingles(pa.array(texts, pa.string()), k)
        want = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []) for w in plain]
        assert np.diff(edge).tolist() == [len(x) for x in want]
        every = [s for x in want for s in x]
        assert len(set(zip(found.tolist(), every))) == len(set(every)) == len(set(found.tolist()))


def test_slices_and_long_words_hash_alike():
    column = pa.array(["drop", "x " + "q" * 3_000_000 + " y", None, "Tail x"])
    part = column.slice(1)
    data, at = words.utf8(part)
    hashes = words.hashes(data, *words.split(data, at)[:2])
    assert len(hashes) == 5 and hashes[0] == hashes[4]
    again, at = words.utf8(pa.array(["q" * 3_000_000]))
    assert words.hashes(again, *words.split(again, at)[:2])[0] == hashes[1]
    batch = pa.record_batch([pa.array(["a" * 10, "b" * 50, None, "c"] * 5)], names=["text"])
    cut = list(words.pieces(batch, most=30))
    assert sum(p.num_rows for p in cut) == 20 and pa.concat_arrays([p.column(0) for p in cut]).equals(batch.column(0))


def test_encoding_by_pieces_equals_whole_text_encoding():
    public = pytest.importorskip("public_tokenizers")
    encode = tokens.encoder(public.path("word_bpe_49k.json"))
    texts = ["", None, "It's they'll A.B c,d", "ÉCOLE élan…, «ñ»  x y z", "\x1ca\x1db", "é ,́ 12.5% a_b--c", "<|endoftext|> o'er", "word " * 50, "ΑΣ Σ. ΟΔΟΣ, İI"]
    ids, edge = encode.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[edge[i] : edge[i + 1]].tolist() == encode.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_superminhash_estimates_jaccard_and_equal_sets_agree():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    pool = [a, a[:900], np.concatenate([a[:500], rng.integers(0, 2**63, 500).astype(np.uint64)]), a[:1], a[:1], np.empty(0, np.uint64)]
    h = superminhash.signatures(np.concatenate(pool), np.concatenate([[0], np.cumsum([len(x) for x in pool])]), 192)
    share = lambda i, j: (h[i] == h[j]).mean()
    assert abs(share(0, 1) - 0.9) < 0.08 and abs(share(0, 2) - 1 / 3) < 0.12 and share(3, 4) == 1
    assert (h[5] == superminhash._EMPTY).all() and not (h[:5] == superminhash._EMPTY).any()
    keys = superminhash.bands(h, 6)
    assert keys.shape == (6, 32) and (keys[3] == keys[4]).all() and len(set(keys[0].tolist())) == 32


def test_block_links_equal_pairwise_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    got = neardup._linked(flat, n, flat, n, 50)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            assert got[i, j] == (100 * common >= 50 * (len(x) + len(y) - common))


def test_local_union_find():
    batch = pa.record_batch([pa.array([5, 9, 3, 8]), pa.array([3, 5, 3, 7])], names=["a", "b"])
    out = pa.Table.from_batches(list(groups._local(iter([batch])))).to_pylist()
    assert {(r["a"], r["b"]) for r in out} == {(5, 3), (9, 3), (8, 7)}


@given(st.integers(1, 100_000))
def test_pieces_are_binary_digits(n):
    cut = packing.pieces_of(n, 4096)
    assert sum(cut) == n and all(c & (c - 1) == 0 and c <= 4096 for c in cut) and cut == sorted(cut, reverse=True)


def test_components_over_several_tasks(spark, monkeypatch):
    """A path, a star, loops, repeats and nulls, dealt over many tasks so that star contractions are needed."""
    from quillrank.llm.storage import Scratch

    monkeypatch.setattr(groups, "LINKS_A_TASK", 7)
    links = [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 330)] + [(5, 5), (None, 4), (7, 6), (6, 7), (160, 90)]
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {i: 90 for i in range(100, 161)} | {i: 300 for i in range(301, 330)} | {7: 6}
    monkeypatch.setattr(groups, "LINKS_A_TASK", 1000)
    again = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert again == got
    assert groups.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0
