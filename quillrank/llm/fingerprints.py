"""Operator 10: threshold-scaled document sketches.

A sketch keeps every 5-word shingle hash below one fixed fraction of the hash range, and the LEAST smallest hashes in any case, so that short texts have sketches too. How far a sketch
reaches (up to which hash it holds all of them) can be told from itself: everywhere if it has fewer than LEAST hashes, else up to the fraction or its last hash. Two sketches
are compared up to where both reach, so that very unequal texts compare fairly, and the share of one in the other estimates containment. Sketches of parts merge
(`merge`, `merge_by`): their union, cut by the same rule, is exactly the sketch of all the parts' shingles together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .storage import bound_batches

WORDS = 5
FRACTION = 1 / 8
LEAST = 64  # hashes that are kept in any case
DEALT = 32  # shares of one key's parts when they are merged


def sketches(column: pa.Array, fraction: float = FRACTION, k: int = WORDS) -> list[np.ndarray]:
    """The sorted kept hashes of each text."""
    found, edge = words.row_shingles(column, k)
    return [kept(np.unique(found[edge[r] : edge[r + 1]]), fraction) for r in range(len(edge) - 1)]


def kept(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """What a sketch keeps of all of a text's sorted hashes."""
    return hashes[: max(LEAST, int(np.searchsorted(hashes, _top(fraction), side="right")))]


def _top(fraction: float) -> np.uint64:
    return np.uint64(min((1 << 64) - 1, int(fraction * 2.0**64)))


def reach(sketch: np.ndarray, fraction: float = FRACTION) -> np.uint64:
    """The hash up to which the sketch holds all hashes of its text."""
    if len(sketch) < LEAST:
        return np.uint64((1 << 64) - 1)
    return max(_top(fraction), sketch[-1])


def _in_reach(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    upto = min(reach(a, fraction), reach(b, fraction))
    return tuple(x[: np.searchsorted(x, upto, side="right")] for x in (a, b))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """The estimated share of the smaller shingle set that the larger one contains; of two texts without shingles, 1, and of one, 0.

    Where none of the smaller one's hashes lies within reach, nothing in common is known and the likeness is 0; that takes a text of few shingles and one of many.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = _in_reach(a, b, fraction)
    return len(np.intersect1d(x, y, assume_unique=True)) / max(1, min(len(x), len(y)))


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """The estimated share of a's shingle set that b's contains; 1 if a has no shingles, and 0 where none of a's lies within reach."""
    if not len(a):
        return 1.0
    x, y = _in_reach(a, b, fraction)
    return len(np.intersect1d(x, y, assume_unique=True)) / max(1, len(x))


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two shingle sets, from their sketches. Neither lacks a hash that the union's sketch keeps."""
    return kept(np.union1d(a, b), fraction)


def written(sketch: np.ndarray) -> str:
    """A sketch as text: its hashes in ascending order, 16 hexadecimal digits each, joined."""
    return sketch.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Returns doc_id and fingerprint for every row; a null text counts as empty. Other columns are ignored."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.pieces(batch):
                marks = pa.array([written(m) for m in sketches(some.column("text"), fraction)], pa.string())
                yield pa.record_batch([some.column("doc_id"), marks], names=["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(sketch, "doc_id long, fingerprint string")


def read(text: str) -> np.ndarray:
    """The hashes of a sketch written as text."""
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge_by(sketches: DataFrame, key: str, fraction: float = FRACTION) -> DataFrame:
    """One sketch for each value of `key` (null included) from sketches (key, fingerprint) that `fingerprint` has made with the same fraction.

    Returns key and fingerprint; other columns are ignored and repeated rows change nothing. A key's parts are merged in DEALT
    shares first, so that a frequent key is spread over tasks; a task holds the one sketch that it builds. Rows with a null fingerprint count as
    empty. An empty table gives an empty result.
    """

    def run(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name = np.empty(0, np.uint64), None
        for batch in batches:
            name = batch.column("key")[0] if name is None else name
            for text in batch.column("fingerprint"):
                now = merge(now, read(text.as_py() or ""), fraction)
        yield pa.record_batch([pa.array([name.as_py()], name.type), pa.array([written(now)], pa.string())], names=["key", "fingerprint"])

    kind = f"key {sketches.schema[key].dataType.simpleString()}, fingerprint string"
    rows = sketches.select(F.col(key).alias("key"), F.col("fingerprint"))
    shares = rows.groupBy("key", F.pmod(F.xxhash64("fingerprint"), F.lit(DEALT)).alias("share")).applyInArrow(run, kind)
    return shares.groupBy("key").applyInArrow(run, kind).withColumnRenamed("key", key)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Deals (doc_id, text) into ranges of descending doc_id, each sorted and followed by the row that comes after it.

    Rows with equal keys (null ones come last) are in order of a hash of the text, and then of the text; a key that fills several ranges is parted by that hash. The
    ranges' bounds are `parts` numbers. A range's first row is copied behind the range before it, and the very first one behind the last,
    so every row finds its successor in its own partition. Adds `_guest`, true on the copies.
    """
    spark, low = docs.sparkSession, -(1 << 63)
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(low))).withColumn("_tie", F.xxhash64("text"))
    cuts = keyed.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] if parts > 1 else None
    bounds, times = np.unique(np.array(cuts or (), np.int64), return_counts=True)
    above = np.concatenate([np.cumsum(times[::-1])[::-1], [0]])  # cuts from each bound upwards

    @F.pandas_udf(T.IntegerType())
    def dealt(i, tie):  # noqa: ANN001, ANN202  0 holds the largest keys
        import pandas as pd

        key, share = i.to_numpy(), (tie.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        at = np.searchsorted(bounds, key, side="right")
        own = np.maximum(at - 1, 0)
        bound = (bounds[own] == key) if len(bounds) else np.zeros(len(key), bool)
        inside = np.minimum((share * times[own]).astype(np.int64), times[own] - 1) if len(bounds) else 0
        return pd.Series(above[at] + np.where(bound, inside, 0), dtype="int32")

    first = F.min(F.struct(F.bitwise_not("_id").alias("down"), "_tie")).alias("top")
    tops = {r["p"]: r["top"] for r in keyed.groupBy(dealt("_id", "_tie").alias("p")).agg(first).collect()}
    used = sorted(tops)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first follows the last
    rows = keyed.withColumn("_p", dealt("_id", "_tie"))
    if not used:
        return rows.withColumn("_guest", F.lit(False)).drop("_p", "_id", "_tie")
    heads = spark.createDataFrame([(~tops[p]["down"], tops[p]["_tie"], before[p]) for p in used], "_id long, _tie long, _to int")
    own, copy = F.struct(F.col("_p").alias("p"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("p"), F.lit(True).alias("g"))
    rows = rows.join(F.broadcast(heads), ["_id", "_tie"], "left").withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.select("doc_id", "text", "_id", "_tie", F.col("_at.p").alias("_p"), F.col("_at.g").alias("_guest"))
    return rows.repartitionById(int(above[0]) + 1, F.col("_p")).sortWithinPartitions("_guest", F.desc("_id"), "_tie", F.asc_nulls_first("text")).drop("_p", "_id", "_tie")


def compare_with_next(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness; see `op10_fingerprints`.

    Null texts are empty. Null keys come last in descending order; rows with equal keys are ordered by a hash of the text, then by the text. A single row is its own successor. An
    empty table gives an empty result.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for batch in batches:
            for some in words.pieces(batch):
                if done:  # a copy of the next range's first row has been met; more copies are repeated rows
                    continue
                texts = [x or "" for x in some.column("text").to_pylist()]
                rows = list(zip(some.column("doc_id").to_pylist(), texts, sketches(some.column("text"), fraction), some.column("_guest").to_pylist(), strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = None if rows[-1][3] else rows[-1]
                last = next((i for i, r in enumerate(rows) if r[3]), len(rows) - 1)
                mine, after, done = rows[:last], rows[1 : last + 1], rows[last][3]
                if not mine:
                    continue
                edited = [(t[: len(t) - len(t) // 2] + n[1][: len(t) // 2]) for (_, t, _, _), n in zip(mine, after, strict=True)]
                marks = sketches(pa.array(edited, pa.string()), fraction)
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in mine], pa.int64()),
                        pa.array([len(r[1]) for r in mine], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([written(r[2]) for r in mine], pa.string()),
                        pa.array([written(m) for m in marks], pa.string()),
                        pa.array([likeness(r[2], m, fraction) for r, m in zip(mine, marks, strict=True)], pa.float64()),
                        pa.array([likeness(r[2], n[2], fraction) for r, n in zip(mine, after, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(rows, parts).mapInArrow(compare, schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and against the next document in descending doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_with_next(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
