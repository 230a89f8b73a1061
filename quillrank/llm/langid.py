"""Operator 9: language identification by a mixture of languages.

Every document is taken as a mixture: each of its byte n-grams is drawn from one of several languages' n-gram distributions.
Expectation-maximisation estimates the proportions, for the one, two, three ... most likely languages, up to all that have a share of one n-gram or
more; the set with the best likelihood less a penalty for each language more is kept, and its largest share is the prediction.

The n-gram distributions are counts over all training documents, in a hashed table of fixed size: languages x BUCKETS numbers, which is what the
driver gathers and broadcasts, whatever the size of the corpus: 128 KB for each language. `most_languages` is the stated bound on their number; labels beyond it
raise an error, since dropping some would change predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .storage import bound_batches, free_name

BUCKETS = 1 << 15
MOST_LANGUAGES = 1024
_U = np.uint64
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes that say nothing about the language become blanks.
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(data: np.ndarray) -> np.ndarray:
    """The buckets of a text's byte trigrams, those of blanks alone left out."""
    if len(data) < 1:
        return np.empty(0, np.int64)
    b = np.full(len(data) + 2, 0x20, np.uint32)
    b[1:-1] = _CLASS[data]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[1:-1] != 0x20)]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _training(held_out: Column) -> Column:
    return ~held_out & F.col("lang").isNotNull()


def held_out(key: str = "doc_id", fold: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % fold == 0


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of docs (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for some in words.pieces(batch):
                data, at = words.utf8(some.column("text"))
                langs = some.column("lang").to_pylist()
                for i, lang in enumerate(langs):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    found = grams(data[at[i] : at[i + 1]])
                    sums[lang] += np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 8 else 0
                    if len(found) <= BUCKETS // 8:
                        np.add.at(sums[lang], found, 1)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n[used])], names=["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and, for each bucket, the probability of its n-grams under each of them."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * BUCKETS) if langs else counts
        self.p = np.ascontiguousarray(p, dtype=np.float32)

    def mixture(self, data: np.ndarray, steps: int = 12) -> list[tuple[str, float]]:
        """The kept languages with their shares, largest first."""
        found = grams(data)
        if not self.langs or not len(found):
            return []
        bucket, n = np.unique(found, return_counts=True)
        p, n = self.p[bucket], n.astype(np.float32)
        total, logs = float(n.sum()), n @ np.log(p)
        order = np.argsort(-logs, kind="stable")
        best, kept = float(logs[order[0]]), [(int(order[0]), 1.0)]
        if len(order) > 1:
            share = self._shares(p, n, np.full(len(order), 1 / len(order), np.float32), steps)
            order = np.argsort(-share, kind="stable")
            for k in range(2, int(np.count_nonzero(share * total >= 1)) + 1):
                own = np.ascontiguousarray(p[:, order[:k]])
                w = self._shares(own, n, share[order[:k]] / share[order[:k]].sum(), steps)
                # Overlapping n-grams count three times over, hence the factor before the usual half log n for each parameter.
                value = float(n @ np.log(own @ w)) - 1.5 * np.log(total) * (k - 1)
                if value > best:
                    best, kept = value, sorted(zip(order[:k].tolist(), w.tolist(), strict=True), key=lambda x: -x[1])
        return [(self.langs[i], min(1.0, s)) for i, s in kept]

    @staticmethod
    def _shares(p: np.ndarray, n: np.ndarray, w: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            last, w = w, w * ((n / (p @ w)) @ p) / n.sum()
            if np.abs(w - last).max() < 1e-3:
                break
        return w


def train(docs: DataFrame, most_languages: int = MOST_LANGUAGES) -> Model:
    """Counts over all rows of docs (text, lang non-null)."""
    rows = count_grams(docs).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if len(langs) > most_languages:
        raise ValueError(f"{len(langs)} languages, 128 KB each in every worker; most_languages is {most_languages}")
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows.column("bucket").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (the share of lang_pred) and languages, a list of (lang, share), to docs.

    Only `text` is read. lang_pred is `und`, score 0 and the list empty if the text is null or has no letter or the model knows no language. Ties go to the
    language first in alphabetical order. Columns named like the new ones are replaced; all others are kept.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "languages")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def infer(text: pa.Array) -> pa.Array:
        known, out = shared.value, []
        for some in words.pieces(pa.record_batch([text], names=["text"])):
            column = some.column("text")
            data, at = words.utf8(column)
            for i, t in enumerate(column.to_pylist()):
                mix = known.mixture(data[at[i] : at[i + 1]]) if t and has_letter(t) else []
                out.append({"lang_pred": mix[0][0] if mix else "und", "score": mix[0][1] if mix else 0.0, "languages": [{"lang": x, "share": s} for x, s in mix]})
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]))

    found = free_name(docs, "found")
    # Not to be run once more for each filter on what it finds.
    return docs.withColumn(found, infer.asNondeterministic()(F.col("text"))).select(*[F.col(f"`{c}`") for c in keep], f"{found}.*")


def identify_by_own_labels(docs: DataFrame) -> DataFrame:
    """Learns from text and non-null lang of the rows of docs outside the held-out fold, then identifies all rows; adds held_out.

    Without any training row every prediction is `und`.
    """
    rows = docs.where(_training(held_out())).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs, train(rows)).withColumn("held_out", held_out())


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_by_own_labels(docs).select("doc_id", "held_out", "lang_pred", "score", "languages")
