"""Operator 1: language-model scoring with a hashed maximum-entropy model.

The model gives P(word | history) = P(class | history) * P(group | class, history) * share of the word in its group. Classes are the most frequent
word endings (two bytes), one for all others, and one for the end of a text. The words of a class fall into GROUPS by their hash. Classes, and groups within
a class, are softmaxes of log-linear models over hashed features of the history: for the class the word before, the pair before (n-grams) and the word
two back (skip); for the group the word before and the pair before, each together with the class. A word has its smoothed share of the counts of
its group, so that the model's vocabulary is the corpus's own, without a bound. The unknown word belongs to all classes, to each in
proportion to its distinct words, and P sums to 1 over all words and the unknown one.

Training passes over all training documents once, in `ROUNDS` rounds that take disjoint parts of them. In a round every task starts from the
shared weights and takes gradient steps on its own documents; the changes of the weights that it met are averaged feature by feature,
weighted by how often each task met the feature. The number of weights follows the counted training tokens (`buckets_for`) up to MOST_BUCKETS rows
(64 MB), which is all that the driver or a worker ever holds; a task takes so many tokens that the changes it sends stay in proportion to its input.
Since every task steps from the shared weights on its own documents, scores depend a little on how the input is dealt into tasks.

Word counts are exact and grow with the corpus. The most frequent words, MOST_KNOWN of them at most, are broadcast; tokens of
other words are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .storage import Scratch

CLASSES, GROUPS = 32, 32
LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 19
TOKENS_PER_BUCKET = 256
TOKENS_PER_SENT_ROW = 32
ROUNDS = 2
STEP = 0.5
BATCH = 2048  # tokens
SMOOTH = 0.1
MOST_KNOWN = 1_000_000  # words: 16 MB
CHUNK = 512  # rows of the weights that are averaged together
TASKS_A_SUM = 64
_U = np.uint64
_END, _NONE = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_END_SUFFIX = 65536


def held_out(key: str = "doc_id", fold: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % fold == 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and endings of the column's texts, each followed by the end token, with the edges of the rows."""
    data, at = words.utf8(column)
    starts, ends, before = words.split(data, at)
    low = words.lowered(data).astype(np.int32)
    suffix = low[ends - 1] | np.where(ends - starts > 1, low[ends - 2] << 8, 0) if len(ends) else np.empty(0, np.int32)
    edge = before + np.arange(len(before))
    is_end = np.zeros(edge[-1], bool)
    is_end[edge[1:] - 1] = True
    word, ending = np.full(edge[-1], _END), np.full(edge[-1], _END_SUFFIX, np.int32)
    word[~is_end], ending[~is_end] = words.hashes(data, starts, ends), suffix
    return word, ending, edge


def buckets_for(tokens: int) -> int:
    """Rows of weights for so many training tokens: a power of two, about one row for TOKENS_PER_BUCKET tokens, within LEAST_BUCKETS and MOST_BUCKETS."""
    return min(MOST_BUCKETS, 1 << max(tokens // TOKENS_PER_BUCKET, LEAST_BUCKETS).bit_length() - 1)


def _features(word: np.ndarray, edge: np.ndarray, label: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each token's history: three for the class softmax, and two for the softmax within the token's class `label`."""
    at = np.arange(len(word)) - np.repeat(edge[:-1], np.diff(edge))

    def back(n: int) -> np.ndarray:
        out = np.full(len(word), _NONE)
        out[n:] = word[:-n] if len(word) > n else word[:0]
        out[at < n] = _NONE
        return out

    one, two = back(1), back(2)
    pair = one * _U(0x9FB21C651E98DF25) + two
    own = (label.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    shift = _U(64 - buckets.bit_length() + 1)
    place = lambda *keys: np.stack([(words.mix(k + _U(j)) >> shift).astype(np.int64) for j, k in keys])
    return place((1, one), (2, pair), (3, two)), place((4, one + own), (5, pair + own))


def _group(word: np.ndarray) -> np.ndarray:
    return ((word >> _U(20)) % _U(GROUPS)).astype(np.int64)


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order of non-negative 32-bit keys, by two passes of numpy's radix sort for 16-bit numbers."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if key.max(initial=0) > 0xFFFF:
        order = order[np.argsort((key[order] >> 16).astype(np.uint16), kind="stable")]
    return order


@dataclass
class Model:
    classes: np.ndarray  # of each ending
    log_share: np.ndarray  # natural logarithm of each class's share of all counts
    log_groups: np.ndarray  # CLASSES x GROUPS: of each group's share of its class's known words
    unknown: np.ndarray  # each class's share of the unknown word over its share of all counts
    weights: np.ndarray  # buckets x 32
    total: float  # N + SMOOTH * (V + 1)
    n: int

    def labels(self, word: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and group of each token."""
        return self.classes[ending], _group(word)

    def log_odds(self, word: np.ndarray, ending: np.ndarray, edge: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln P(word | history) - ln P(word) of each token as a known word, and of the tokens at `other` as the unknown word."""
        label, group = self.labels(word, ending)
        above, within = _features(word, edge, label, len(self.weights))
        out, unknown, ones = np.empty(len(label)), np.zeros(len(label)), np.ones(self.weights.shape[1], np.float32)
        for lo in range(0, len(label), BATCH):
            own, part = label[lo : lo + BATCH], group[lo : lo + BATCH]
            rows = np.arange(len(own))
            p = self.logits(above[:, lo : lo + BATCH], self.log_share)
            out[lo : lo + BATCH] = p[rows, own] - self.log_share[own]
            np.exp(p, out=p)
            total = p @ ones
            some = np.flatnonzero(other[lo : lo + BATCH])
            unknown[lo + some] = np.log((p[some] @ self.unknown) / total[some])
            p = self.logits(within[:, lo : lo + BATCH], self.log_groups.take(own, axis=0))
            out[lo : lo + BATCH] += p[rows, part] - self.log_groups[own, part] - np.log(total)
            out[lo : lo + BATCH] -= np.log(np.exp(p, out=p) @ ones)
        return out, unknown[other]

    def logits(self, feature: np.ndarray, prior: np.ndarray) -> np.ndarray:
        z = self.weights.take(feature[0], axis=0)
        for f in feature[1:]:
            z += self.weights.take(f, axis=0)
        z += prior
        return z

    def learn(self, word: np.ndarray, ending: np.ndarray, edge: np.ndarray, met: np.ndarray) -> None:
        """One gradient step per BATCH tokens; `met` counts the occurrences of each feature so far, by which its steps shrink."""
        label, group = self.labels(word, ending)
        above, within = _features(word, edge, label, len(self.weights))
        for lo in range(0, len(label), BATCH):
            own = label[lo : lo + BATCH]
            self._step(above[:, lo : lo + BATCH], self.log_share, own, met)
            self._step(within[:, lo : lo + BATCH], self.log_groups.take(own, axis=0), group[lo : lo + BATCH], met)

    def _step(self, feature: np.ndarray, prior: np.ndarray, target: np.ndarray, met: np.ndarray) -> None:
        z = self.logits(feature, prior)
        np.exp(z, out=z)
        z /= -(z @ np.ones(z.shape[1], np.float32))[:, None]
        z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target] += 1
        flat = feature.reshape(-1)
        order = _order(flat)
        ranked = flat.take(order)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        which, n = ranked.take(first), np.diff(np.append(first, len(flat)))
        met[which] += n
        step = (STEP / (1 + np.sqrt(met.take(which)))).astype(np.float32)
        change = _folded(z.take(order % len(z), axis=0), first, n)
        change *= step[:, None]
        change += self.weights.take(which, axis=0)
        whole = f"V{change.strides[0]}"  # a row as one value, which is copied at once
        np.put(self.weights.view(whole), which, change.view(whole))


def _folded(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of the stretches of rows that begin at `first` and have n rows, by folding their second halves onto the first ones."""
    at, left = first, n
    while True:
        many = left > 1
        if not many.any():
            return rows.take(first, axis=0)
        at, left = at[many], left[many]
        half = (left + 1) >> 1
        moved = left - half
        upto = np.cumsum(moved)
        to = np.repeat(at - upto + moved, moved) + np.arange(upto[-1])
        rows[to] = rows.take(to, axis=0) + rows.take(to + np.repeat(half, moved), axis=0)
        left = half


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, c, part) over all rows of docs (text); part is the word's group."""

    def add(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import pandas as pd

        word, ending, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, distinct = pd.factorize(word)
        suffix = np.empty(len(distinct), np.int32)
        suffix[code] = ending
        return distinct, suffix, np.bincount(code, weights=n, minlength=len(distinct)).astype(np.int64)

    def emit(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(x[0]), 100_000):
            w, s, n = (c[lo : lo + 100_000] for c in x)
            yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(s), pa.array(n)], names=["word", "ending", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for some in words.pieces(batch):
                word, ending, _ = _tokens(some.column("text"))
                held.append(add([(word, ending, np.ones(len(word), np.int64))]))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    held = [add(held)]
                    if len(held[0][0]) > 500_000:
                        yield from emit(held.pop())
        if held:
            yield from emit(add(held))

    counted = docs.select("text").mapInArrow(run, "word long, ending int, c long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))
    return counted.withColumn("part", F.pmod(F.shiftrightunsigned("word", 20), F.lit(GROUPS)).cast("int"))


def _untrained(vocabulary: DataFrame) -> Model:
    """The model before any step."""
    rows = vocabulary.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # 65,537 rows at most
    n, v = sum(r["c"] for r in rows), sum(r["v"] for r in rows)
    total = n + SMOOTH * (v + 1)
    classes = np.full(_END_SUFFIX + 1, CLASSES - 2)
    classes[_END_SUFFIX] = CLASSES - 1
    for i, r in enumerate(sorted((r for r in rows if r["ending"] != _END_SUFFIX), key=lambda r: (-r["c"], r["ending"]))[: CLASSES - 2]):
        classes[r["ending"]] = i
    distinct, share = np.full(CLASSES, 1e-9), np.zeros(CLASSES)
    for r in rows:
        distinct[classes[r["ending"]]] += r["v"]
        share[classes[r["ending"]]] += r["c"] + SMOOTH * r["v"]
    unknown = distinct / distinct.sum()
    share = (share + SMOOTH * unknown) / total
    own = [i for i in np.flatnonzero(classes < CLASSES - 2).tolist()] + [_END_SUFFIX]
    which = F.when(F.col("ending").isin(own), F.col("ending")).otherwise(-1)
    groups = np.full((CLASSES, GROUPS), 1e-9)
    for r in vocabulary.groupBy(which.alias("own"), "part").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES x GROUPS rows at most
        groups[CLASSES - 2 if r["own"] < 0 else classes[r["own"]], r["part"]] += r["c"] + SMOOTH * r["v"]
    groups /= groups.sum(axis=1, keepdims=True)
    weights = np.zeros((buckets_for(n), max(CLASSES, GROUPS)), np.float32)
    return Model(classes, np.log(share).astype(np.float32), np.log(groups).astype(np.float32), (unknown / share).astype(np.float32), weights, total, n)


def _round(docs: DataFrame, model: Model) -> np.ndarray:
    """The averaged update of the weights from one pass over docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size, lanes = model.weights.shape

    def send(chunk: int, at: np.ndarray, met: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        some = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), met.astype(np.int64), change.astype(np.float16))]
        return pa.record_batch([pa.array([chunk], pa.int32()), *some], names=["chunk", "at", "met", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own, met = replace(start, weights=start.weights.copy()), np.zeros(size, np.int64)
        for batch in batches:
            for some in words.pieces(batch):
                own.learn(*_tokens(some.column("text")), met)
        task = TaskContext.get().partitionId()
        for lo in range(0, size, CHUNK):
            at = np.flatnonzero(met[lo : lo + CHUNK])
            if len(at):
                out = send(lo // CHUNK, at, met[lo + at], own.weights[lo + at] - start.weights[lo + at])
                yield pa.record_batch([*out.columns, pa.array([task // TASKS_A_SUM], pa.int32())], names=[*out.schema.names, "sum"])

    def average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, met = np.zeros((CHUNK, lanes)), np.zeros(CHUNK, np.int64)
        for batch in batches:
            for a, m, c in zip(batch.column("at"), batch.column("met"), batch.column("change"), strict=True):
                at, n = np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(m.as_buffer(), np.int64)
                change[at] += np.frombuffer(c.as_buffer(), np.float16).reshape(len(at), lanes).astype(np.float64) * n[:, None]
                met[at] += n
        at = np.flatnonzero(met)
        yield send(key[0].as_py(), at, met[at], change[at] / met[at, None])

    kind = "chunk int, at binary, met binary, change binary"
    sent = docs.select("text").mapInArrow(run, f"{kind}, sum int")
    # Averages of up to TASKS_A_SUM tasks first, so that no group grows with the number of tasks.
    got = sent.groupBy("chunk", "sum").applyInArrow(average, kind).groupBy("chunk").applyInArrow(average, kind)
    out = np.zeros((size, lanes), np.float32)
    for r in got.select("chunk", "at", "change").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint16)
        out[r["chunk"] * CHUNK + at.astype(np.int64)] = np.frombuffer(r["change"], np.float16).reshape(len(at), lanes)
    shared.destroy()
    return out


def train(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> Model:
    """Trains on all rows of docs (key, text); the rounds take them by a hash of the key.

    A task takes at least TOKENS_PER_SENT_ROW tokens for each row of the weights, so that what it sends back (80 bytes a row at most) stays below its input.
    """
    model = _untrained(vocabulary)
    tasks = max(1, model.n // (TOKENS_PER_SENT_ROW * len(model.weights)))
    for turn in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64(key, "text"), F.lit(ROUNDS)) == turn)
        model.weights = model.weights + _round(part.coalesce(tasks), model)
    return model


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of docs; other columns are ignored.

    A null text counts as empty: its one token is the end. Null keys and repeated rows are scored like any others. A vocabulary without words
    gives every token the probability of the one unknown word.
    """
    spark = docs.sparkSession
    # Words by the power of two of their count: the commonest whole powers that fit are broadcast.
    power = F.floor(F.log2("c"))
    by_power = sorted(vocabulary.groupBy(power.alias("p")).count().collect(), key=lambda r: -r["p"])
    least, known = 1 << 62, 0
    for r in by_power:
        known += r["count"]
        if known > MOST_KNOWN:
            break
        least = 1 << r["p"]
    frequent = F.log2("c") >= float(np.log2(least)) if least > 1 else F.lit(True)
    table = vocabulary.where(frequent).select("word", "c").toArrow()
    word, c = table.column("word").to_numpy().view(np.uint64), table.column("c").to_numpy()
    order = np.argsort(word)
    log_total = float(np.log10(model.total))
    shared = spark.sparkContext.broadcast((model, word[order], np.log10(c[order] + SMOOTH) - log_total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        own, common, value = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in words.pieces(batch):
                word, ending, edge = _tokens(some.column("text"))
                n = np.diff(edge)
                code, distinct = pd.factorize(word)
                found, base = np.zeros(len(word), bool), np.zeros(len(word))
                if len(common):
                    spot = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
                    hit = common[spot] == distinct
                    found, base = hit[code], np.where(hit, value[spot], 0.0)[code]
                odds, unknown = own.log_odds(word, ending, edge, ~found)
                odds, unknown = odds / np.log(10), unknown / np.log(10)
                at = np.concatenate([[0], np.cumsum(np.add.reduceat((~found).astype(np.int64), edge[:-1]))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (word[~found].view(np.int64), odds[~found], unknown)]
                sums = [pa.array(np.add.reduceat(x, edge[:-1])) for x in (found.astype(np.int64), base, odds * found)]
                yield pa.record_batch([pa.array(row + np.arange(len(n))), some.column("doc_id"), pa.array(n), *sums, *lists], names=names)
                row += len(n)

    names = ["row", "doc_id", "n_tokens", "n_frequent", "base", "gain", "word", "known", "unknown"]
    schema = "row long, doc_id long, n_tokens long, n_frequent long, base double, gain double, word array<long>, known array<double>, unknown array<double>"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = scratch.save(rows.mapInArrow(run, schema), "scored")
    other = scored.select("row", F.explode(F.arrays_zip("word", "known", "unknown")).alias("t")).groupBy("row", F.col("t.word").alias("word"))
    other = other.agg(F.count(F.lit(1)).alias("tf"), F.sum("t.known").alias("known"), F.sum("t.unknown").alias("unknown"))
    other = other.join(vocabulary.where(~frequent).select("word", "c"), "word", "left")
    looked_up = other.groupBy("row").agg(
        F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) - log_total)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("known")).otherwise(F.col("unknown"))).alias("more_gain"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_more"),
    )
    out = scored.drop("word", "known", "unknown").join(looked_up, "row", "left")
    n_known = (F.col("n_frequent") + F.coalesce("n_more", F.lit(0))).cast("long")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    gain = F.col("gain") + F.coalesce("more_gain", F.lit(0.0))
    return out.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"), base.alias("base_score"), (base + gain).alias("score"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those outside the held-out tenth."""
    scratch = Scratch(spark, "op1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = docs.where(~held_out())
    vocabulary = scratch.save(count_words(own), "vocabulary")
    model = train(own, vocabulary)
    return score(docs, model, vocabulary, scratch).withColumn("held_out", held_out())
