"""Vectorised word and shingle hashing over Arrow text columns.

Words are the maximal runs of bytes other than blank and the five ASCII control blanks (0x09-0x0D), after
A-Z has been lower-cased. UTF-8 never uses those bytes inside a longer character, so working on bytes gives
the same words as working on characters. A null text counts as empty.

Everything here runs inside Spark tasks, a few megabytes of text at a time: `pieces` cuts a record batch so that
the working arrays stay bounded whatever the batch holds; only one very long text has larger ones, in proportion to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: By length: what a word's first block is mixed with, and the bytes of a block that belong to the word.
_LONG = 64
_SEED = mix(np.arange(_LONG + 2, dtype=np.uint64) * _U(_STEP) + _U(0xD6E8FEB86659FD93))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batch with about `most` bytes of text each; a longer text gets a slice of its own."""
    _, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or at.size == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and one past) the number of words before it."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    word = ~blank[1:-1]
    starts = np.flatnonzero(word & (blank[:-2] | first[:-1]))
    ends = np.flatnonzero(word & (blank[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def padded(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """A copy of the bytes, lower-cased if asked, with 8 zeros behind."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[:-8] = _LOWER[data] if lower else data
    return out


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of a padded array, as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word.

    Words of one length up to 8 bytes have different hashes. Longer ones are mixed block by block with bijections that are not linear, so that no
    pattern of bytes collides by construction; words above 64 bytes are digested by BLAKE2.
    """
    raw = padded(data, lower)
    block, n = _eights(raw), ends - starts
    out = mix((block[starts] & _MASK[np.minimum(n, 8)]) ^ _SEED[np.minimum(n, _LONG + 1)])
    some, at = np.flatnonzero(n > 8), 8
    while len(some) and at < _LONG:
        part = block[starts[some] + at] & _MASK[np.minimum(n[some] - at, 8)]
        out[some] = mix(out[some] * _U(0x9FB21C651E98DF25) ^ part)
        at += 8
        some = some[n[some] > at]
    for i in some.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of the padded array a from each of a_at are those of b from b_at."""
    x, y = _eights(a), _eights(b)
    out, some, at = np.ones(len(n), bool), np.arange(len(n)), 0
    while len(some) and at < _LONG:
        mask = _MASK[np.minimum(n[some] - at, 8)]
        out[some] = same = (x[a_at[some] + at] & mask) == (y[b_at[some] + at] & mask)
        at += 8
        some = some[same & (n[some] > at)]
    for i in some.tolist():
        out[i] = np.array_equal(a[a_at[i] : a_at[i] + n[i]], b[b_at[i] : b_at[i] + n[i]])
    return out


def shingles(word: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and for each row (and one past) how many come before it.

    A row with 1 to k - 1 words has one shingle, its whole sequence; a row without words has none.
    """
    n = np.diff(before)
    short = np.flatnonzero((n > 0) & (n < k))
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    edge = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(edge[-1]), np.uint64)
    full = chain(word, k)
    if not len(short) and len(full):
        keep = np.ones(len(full), bool)
        for j in range(1, k):  # runs that would cross into the next row
            gone = before[1:-1] - j
            keep[gone[(gone >= 0) & (gone < len(full))]] = False
        return full[keep], edge
    for r in range(len(n)):
        if n[r] >= k:
            out[edge[r] : edge[r + 1]] = full[before[r] : before[r] + count[r]]
        elif n[r]:
            out[edge[r]] = chain(word[before[r] : before[r + 1]], int(n[r]))[0]
    return out, edge


def chain(word: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the runs of k consecutive words."""
    m = len(word) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = word[:m] + _U((k * _STEP) & 0xFFFFFFFFFFFFFFFF)
    for j in range(1, k):
        acc = (acc ^ (acc >> _U(29))) * _U(0x9FB21C651E98DF25) + word[j : j + m]
    return mix(acc)


def row_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a text column with the edges of its rows."""
    data, at = utf8(column)
    starts, ends, before = split(data, at)
    return shingles(hashes(data, starts, ends), before, k)
