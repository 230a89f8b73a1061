"""Operator 2: benchmark decontamination by SimHash over item-sized windows.

All windows of every document get 64-bit SimHash fingerprints of their words, each occurrence counting once, in a few widths: a benchmark item of L
words is searched for in windows of the largest width of the series 5, 6, 7, 8, 10, 12, 15 ... (steps of a quarter) that is at most 0.9 L. Three fingerprints
stand for the item, of its first, middle and last words, so that a change at either end leaves one of them as it was.

Multi-index Hamming blocks find every fingerprint within RADIUS: of 4 blocks of 16 bits that together differ in at most 7 bits, one differs in at
most 1, so a table for each block, with each fingerprint entered under its own value and the 16 that differ in a bit, misses none. A fingerprint found says
where the item would begin; the windows of the item's own length from there on, an eighth of it to either side, are verified by the exact weighted Jaccard
similarity of 5-word shingles, a shingle's weight being its number of occurrences.

The benchmark is a query set: its items are broadcast in blocks of at most MOST_WORDS words. A larger benchmark takes a pass over the documents for each
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .storage import Scratch, bound_batches, bounded, free_name

WORDS = 5
LEAST = 0.8
BITS, BLOCKS, RADIUS = 64, 4, 7
STEP = 1 << 13  # windows whose fingerprints are formed at once
MOST_WORDS = 2_000_000  # of items in a broadcast block: some 60 MB
_U = np.uint64
#: A block's own value and those that differ in one bit, as what to change.
_NEAR = np.array([0] + [1 << i for i in range(16)], np.uint16)


def _summed(word: np.ndarray, kind: type) -> np.ndarray:
    """Running sums of the words' votes, +1 or -1 for each bit; the first row is zero."""
    bits = np.unpackbits(words.mix(word).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").view(np.int8)
    bits += bits
    bits -= 1
    out = np.zeros((len(word) + 1, BITS), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def simhashes(summed: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints of all windows of `width` words: a bit is set where the votes' sum is positive."""
    return np.packbits(summed[width:] > summed[: len(summed) - width], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def width_for(n: int) -> int:
    """The width of the windows in which an item of n words is searched for."""
    width = 5
    if n <= width:
        return n
    while width + max(1, width // 4) <= 0.9 * n:
        width += max(1, width // 4)
    return width


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / max(1, len(a) + len(b) - common)


class Table:
    """The fingerprints of the items of one width, by the values of their blocks."""

    def __init__(self, prints: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        self.prints, self.item, self.offset = prints, item, offset
        self.any = np.zeros((BLOCKS, 1 << 16), bool)
        self.first, self.entry = [], []
        for b, value in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS).T):
            under = (value[:, None] ^ _NEAR).reshape(-1)
            order = np.argsort(under, kind="stable")
            self.any[b, under] = True
            self.first.append(np.searchsorted(under[order], np.arange((1 << 16) + 1)))
            self.entry.append(order // len(_NEAR))

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in marks, fingerprint) that differ in at most RADIUS bits; a pair may come more than once."""
        value = marks.view(np.uint16).reshape(-1, BLOCKS)
        places, prints = [], []
        for b in range(BLOCKS):
            at = np.flatnonzero(self.any[b].take(value[:, b]))
            lo, hi = self.first[b][value[at, b]], self.first[b][value[at, b].astype(np.int64) + 1]
            n = hi - lo
            upto = np.cumsum(n)
            found = self.entry[b][np.repeat(lo - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
            place = np.repeat(at, n)
            close = np.bitwise_count(marks[place] ^ self.prints[found]) <= RADIUS
            places.append(place[close])
            prints.append(found[close])
        return np.concatenate(places), np.concatenate(prints)


class Index:
    """A block of items: their shingles, and for each width the table of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        data, at = words.utf8(pa.array(texts, pa.string()))
        starts, ends, before = words.split(data, at)
        word = words.hashes(data, starts, ends)
        self.ids, self.length = ids, np.diff(before)
        self.own = [words.chain(word[a:b], min(WORDS, b - a)) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for i, n in enumerate(self.length.tolist()):
            if n:
                width = width_for(n)
                marks = simhashes(_summed(word[before[i] : before[i + 1]], np.int32), width)
                entries.setdefault(width, []).extend((int(marks[o]), i, o) for o in sorted({0, (n - width) // 2, n - width}))
        self.tables = {w: Table(*(np.array(x, t) for x, t in zip(zip(*e, strict=True), (np.uint64, np.int64, np.int64), strict=True))) for w, e in entries.items()}
        self.widest = max(self.tables, default=0)

    def candidates(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word of the item) where windows agree with an item's fingerprint; `row` tells which text each word is of, and windows stay in one."""
        rows, items, firsts = ([np.empty(0, np.int64)] for _ in range(3))
        kind = np.int16 if STEP + self.widest < 1 << 15 else np.int32
        for lo in range(0, len(word) if self.tables else 0, STEP):
            summed = _summed(word[lo : lo + STEP + self.widest - 1], kind)
            for width, table in self.tables.items():
                marks = simhashes(summed[: STEP + width], width) if len(summed) > width else np.empty(0, np.uint64)
                if not len(marks):
                    continue
                at, which = table.near(marks)
                whole = row[lo + at] == row[lo + at + width - 1]
                rows.append(row[lo + at[whole]])
                items.append(table.item[which[whole]])
                firsts.append(lo + at[whole] - table.offset[which[whole]])
        return np.concatenate(rows), np.concatenate(items), np.concatenate(firsts)

    def verified(self, word: np.ndarray, item: int, first: np.ndarray) -> tuple[float, int] | None:
        """The similarity and place of the best of the text's windows around the places in `first`; None if none is similar enough."""
        n = int(self.length[item])
        k, reach = min(WORDS, n), n // 8 + 1
        tried = np.unique((first[:, None] + np.arange(-reach, reach + 1)).reshape(-1))
        tried = tried[(tried >= 0) & (tried <= len(word) - n)]
        if not len(tried):
            return None
        shingle, base, best = words.chain(word[tried[0] : tried[-1] + n], k), int(tried[0]), (0.0, -1)
        for at in tried.tolist():
            value = similarity(shingle[at - base : at - base + n - k + 1], self.own[item])
            if value > best[0]:
                best = (value, at)
            if value == 1.0:
                break
        return best if best[0] >= LEAST else None


def _grouped(row: np.ndarray, item: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each text and item with the item's possible places."""
    order = np.lexsort((first, item, row))
    row, item, first = row[order], item[order], first[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    cut = [*np.flatnonzero(new).tolist(), len(row)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(row[a]), int(item[a]), np.unique(first[a:b])


def _search(docs: DataFrame, index: Index) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for some in words.pieces(batch):
                data, at = words.utf8(some.column("text"))
                starts, ends, before = words.split(data, at)
                word = words.hashes(data, starts, ends)
                row = np.repeat(np.arange(some.num_rows), np.diff(before))
                keys, held = some.column("doc_id"), {}
                for r, i, at in _grouped(*known.candidates(word, row)):
                    best = known.verified(word[before[r] : before[r + 1]], i, at - before[r])
                    if best and best[0] > held.get((r, known.ids[i]), (0.0,))[0]:
                        held[r, known.ids[i]] = (best[0], best[1], int(known.length[i]))
                rows = [(keys[r].as_py(), item, at, n, value) for (r, item), (value, at, n) in held.items()]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (keys.type, pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.record_batch(columns, names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, item_id long, first_word long, n_words long, similarity double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, first_word, n_words and similarity of the best window.

    Texts are lower-cased first. Items or documents without words (null texts included) match nothing; an item of fewer than five words
    has one shingle, all of it, and so matches only exactly. Of equally similar windows the first is returned. Repeated items with one id count as one,
    by their best window; repeated documents give repeated rows. Null keys are returned as they are. Empty tables give an empty result.
    """
    return _find(docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.col(text)).alias("text")), benchmark, item, item_text)


def _find(rows: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.lower(F.col(item_text)).alias("text")).where("text is not null and item_id is not null").distinct()
    out, held, size = None, [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        held.append(r)
        size += len(r["text"].split())
        if size >= MOST_WORDS:
            part = _search(rows, Index([r["item_id"] for r in held], [r["text"] for r in held]))
            out, held, size = part if out is None else out.unionByName(part), [], 0
    if held or out is None:
        part = _search(rows, Index([r["item_id"] for r in held], [r["text"] for r in held]))
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Each row is judged by its own text, whatever other rows share its key or have none.

    Null-safe keys and 128-bit digests of the text name the rows that leak, so that rows go together only if key and text are equal.
    """
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), digest)
    row = free_name(docs, "row")
    named = docs.withColumn(row, name)
    rows = named.select(F.col(row).alias("doc_id"), F.lower(F.col("text")).alias("text"))
    leaks = scratch.save(_find(rows, benchmark).select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return named.join(bounded(leaks, 500_000), row, "left_anti").drop(row)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
