"""Token ids by a public tokenizer, encoded once per distinct piece of text.

A text is cut at ASCII blanks, and between an ASCII letter and a following ASCII punctuation mark other than the
apostrophe. The tokenizers used here never join characters across such places, so a text's ids are its pieces' ids in
a row. Each Python worker keeps the ids of the pieces it has seen in flat arrays, so that a frequent word is encoded
once and not a million times; the memory is bounded by `_MOST` pieces and `_MOST_BYTES` of them, beyond which only those stay that have been met again since the last time. Texts that
hold the string of a special token are encoded whole, so that they too get the ids that the library gives them. Pieces are found by
a 64-bit hash and then compared byte by byte; a text with a piece that shares another's hash is encoded whole too. A new
encoder first checks on a probe that piece-wise and whole-text encoding agree, and refuses the tokenizer otherwise.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import words

_MOST = 300_000
_MOST_BYTES = 16 << 20
_LOADED: dict[str, Encoder] = {}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = True


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lower = all(self._plain(c) == self._plain(c.lower()) for c in upper)
        self.forget()
        probe = "It's 12,5 ÉTÉ\tover-all.\n«Ñandú» x_y They'll, a.b@c.de A-Z (q) o'er 'tis e.. ...\r\nend"
        if self.encode(pa.array([probe]))[0].tolist() != self._plain(probe):
            raise ValueError(f"{path}: this tokenizer joins text across white space or punctuation")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.tiers: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes and their slots, each at most half the one before
        self.n, self.start, self.count = 0, np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used, self.ids = 0, np.empty(1 << 20, self.dtype)
        self.filled, self.bytes = 0, np.zeros(1 << 20, np.uint8)
        self.byte_at, self.byte_count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, bool)

    def _shed(self) -> None:
        """Drops the pieces that have not been met again; all of them if most have."""
        kept = np.flatnonzero(self.met[: self.n])
        if len(kept) > _MOST // 2 or self.byte_count[kept].sum() > _MOST_BYTES // 2:
            return self.forget()
        hashes = np.empty(self.n, np.uint64)
        for known, slot in self.tiers:
            hashes[slot] = known
        hashes, old = hashes[kept], (self.ids, self.start[kept], self.count[kept], self.bytes, self.byte_at[kept], self.byte_count[kept].astype(np.int64))
        self.forget()
        ids, ids_at = _gathered(*old[:3])
        raw, raw_at = _gathered(*old[3:])
        self._room(len(kept), len(ids), len(raw))
        self.ids[: len(ids)], self.start[: len(kept)], self.count[: len(kept)], self.used = ids, ids_at, old[2], len(ids)
        self.bytes[: len(raw)], self.byte_at[: len(kept)], self.byte_count[: len(kept)], self.filled = raw, raw_at, old[5], len(raw)
        self.n = len(kept)
        order = np.argsort(hashes)
        self.tiers = [(hashes[order], order)] if len(order) else []

    def _room(self, pieces: int, ids: int, size: int) -> None:
        """Makes room for so many more pieces, ids and bytes."""
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.filled + size + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while self.n + pieces > len(self.start):
            self.start, self.count, self.byte_at, self.byte_count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count, self.byte_at, self.byte_count))
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])

    def _keep(self, texts: list[bytes]) -> None:
        """Stores the bytes of the pieces that are about to be learned."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(sizes.sum())
        self._room(len(texts), 0, total)
        self.bytes[self.filled : self.filled + total] = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_at[self.n : self.n + len(texts)] = self.filled + np.cumsum(sizes) - sizes
        self.byte_count[self.n : self.n + len(texts)] = sizes
        self.filled += total

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        for lo in range(0, len(texts), 5_000):
            some = texts[lo : lo + 5_000]
            # One joined text is quickest. It will do when each piece came out as one word of the tokenizer's own.
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            if not got.word_ids or got.word_ids[-1] != len(some) - 1:
                got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, sizes = np.array(got.ids, self.dtype), np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
            self._room(len(some), len(ids), 0)
            self.ids[self.used : self.used + len(ids)] = ids
            self.count[self.n : self.n + len(some)] = sizes
            self.start[self.n : self.n + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            self.n += len(some)
        known, slot = hashes, np.arange(self.n - len(hashes), self.n)
        while self.tiers and len(self.tiers[-1][0]) < 2 * len(known):
            a, b = self.tiers.pop()
            known, slot = np.concatenate([a, known]), np.concatenate([b, slot])
        order = np.argsort(known)
        self.tiers.append((known[order], slot[order]))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = np.full(len(hashes), -1)
        for known, at in self.tiers:
            left = np.flatnonzero(slot < 0)
            spot = np.minimum(np.searchsorted(known, hashes[left]), len(known) - 1)
            hit = known[spot] == hashes[left]
            slot[left[hit]] = at[spot[hit]]
        return slot

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts in a row, and the n + 1 edges of its rows. Null is empty."""
        import pandas as pd

        data, at = words.utf8(column)
        starts, ends, _ = words.split(data, at)
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(at), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[at[:-1][at[:-1] < len(data)]] = False
        stop = cut.copy()
        cut[starts] = True
        starts = np.flatnonzero(cut)
        cut[:] = False
        cut[ends - 1] = True
        cut[np.flatnonzero(stop) - 1] = True
        ends = np.flatnonzero(cut) + 1
        code, distinct = pd.factorize(words.hashes(data, starts, ends, lower=self.lower))
        if self.n + len(distinct) > _MOST or self.filled > _MOST_BYTES:
            self._shed()
        slot = self._find(distinct)
        first, size = np.empty(len(distinct), np.int64), ends - starts
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        new, old = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
        raw = words.padded(data, self.lower)
        same = (size == size[first[code]]) & words.equal(raw, starts, raw, starts[first[code]], size)
        if len(old):
            known, own = slot[old], first[old]
            self.met[known] = True
            fits = self.byte_count[known] == size[own]
            fits[fits] = words.equal(self.bytes, self.byte_at[known[fits]], raw, starts[own[fits]], size[own[fits]])
            if not fits.all():
                same &= ~np.isin(code, old[~fits])
        if len(new):
            own = first[new]
            kept = [raw[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            texts = [k.decode() for k in kept]
            plain = np.fromiter(map(str.isalpha, texts), bool, len(texts))
            for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
                if len(some):
                    slot[new[some]] = np.arange(self.n, self.n + len(some))
                    self._keep([kept[i] for i in some])
                    self._learn(distinct[new[some]], [texts[i] for i in some])
        lo, n = self.start[slot][code], self.count[slot][code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(lo - upto[:-1], n) + np.arange(upto[-1])]
        edge = upto[np.searchsorted(starts, at)]
        strange = np.searchsorted(at, starts[~same], side="right") - 1
        for r in sorted({*self._with_special(data, at), *strange.tolist()}):
            own = np.array(self._plain(data[at[r] : at[r + 1]].tobytes().decode()), self.dtype)
            ids = np.concatenate([ids[: edge[r]], own, ids[edge[r + 1] :]])
            edge[r + 1 :] += edge[r] + len(own) - edge[r + 1]
        return ids, edge

    def _with_special(self, data: np.ndarray, at: np.ndarray) -> set[int]:
        """The rows in which a special token's string occurs, in any case."""
        low, found = words.lowered(data).tobytes(), set()
        for s in self.special:
            i = low.find(s)
            while i >= 0:
                found.add(int(np.searchsorted(at, i, side="right")) - 1)
                i = low.find(s, i + 1)
        return found


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat in a row, and where each begins."""
    upto = np.cumsum(count)
    at = upto - count
    return flat[np.repeat(start - at, count) + np.arange(upto[-1] if len(upto) else 0)], at


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
