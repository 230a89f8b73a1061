"""Operator 13: how far the sources of a language diverge, by products of one-hot level matrices.

A group is a (lang, source) pair. What a term weighs in a group depends only on how often it occurs there, its count level. With one indicator column for each
(group, level) and one row for each kept term, the product of the transposed matrix with itself holds, for each two levels of two groups, the number of terms that have both:
every joint table of two groups at once. Pricing the occupied cells and summing them gives every pair of groups without ever pairing their terms.

The matrix is dealt by stretches of terms. A stretch is multiplied in blocks: few enough rows that 32-bit floats count exactly, and few enough columns to stay small.
Prices and sums are whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .storage import Scratch, bounded

STRETCH = 4096  # terms that one task multiplies together; 32-bit floats count exactly to 16 million
_ROWS, _COLUMNS = 64, 1024  # the least rows of a block, and the columns above which it is halved and of a tile
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BATCH = 4 << 20


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    got = column.fill_null("").dictionary_encode()
    return got.indices.to_numpy(), got.dictionary.to_pylist()


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it); a term comes again for each few megabytes of text.

    Terms are the runs of ASCII letters, lower-cased, and of all characters above ASCII. Nulls count as empty strings.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, most=_BATCH):
                yield _counted(piece)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _counted(piece: pa.RecordBatch) -> pa.RecordBatch:
    data, at = words.utf8(piece.column("text"))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    row = np.repeat(np.arange(piece.num_rows), np.diff(np.searchsorted(starts, at)))
    term, first = _distinct(data, starts, ends)
    (a, langs), (b, sources) = _codes(piece.column("lang")), _codes(piece.column("source"))
    group = a.astype(np.int64) * len(sources) + b
    own, many = np.unique(row * len(first) + term, return_counts=True)  # (document, term)
    key = group[own // max(1, len(first))] * len(first) + own % max(1, len(first))
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    n, held = (np.add.reduceat(x[order], head) if len(head) else np.empty(0, np.int64) for x in (many.astype(np.int64), np.ones(len(many), np.int64)))
    found, raw = key[order][head], words.lowered(data)
    terms = pa.array([raw[starts[i] : ends[i]].tobytes() for i in first], pa.binary()).cast(pa.string())
    group, code = found // max(1, len(first)), found % max(1, len(first))
    columns = [pa.array(langs, pa.string()).take(pa.array(group // max(1, len(sources)))), pa.array(sources, pa.string()).take(pa.array(group % max(1, len(sources)))), terms.take(pa.array(code)), pa.array(n), pa.array(held)]
    return pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word by its lower-cased bytes, and where each number's first word stands. Words with one hash are compared byte by byte."""
    import pandas as pd

    code, distinct = pd.factorize(words.hashes(data, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    raw, size = words.padded(data), ends - starts
    same = (size == size[first[code]]) & words.equal(raw, starts, raw, starts[first[code]], size)
    if not same.all():
        code, distinct = pd.factorize(np.array([raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], object))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def _price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 terms)), in decimals as counts may be large."""
    above = F.lit(10**9).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)")) + 1


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


class Blocks:
    """The joint tables of one stretch of terms: cells (column, column, terms that have both) of the product of its one-hot matrix."""

    def __init__(self, term: np.ndarray, group: np.ndarray, level: np.ndarray, groups: int) -> None:
        """An entry for each term and group where the term occurs, with its count; terms are numbered from 0."""
        self.n, self.groups = int(term.max()) + 1 if len(term) else 0, groups
        total = np.bincount(term, weights=level.astype(float), minlength=self.n)
        place = np.empty(self.n, np.int64)
        place[np.argsort(total, kind="stable")] = np.arange(self.n)  # terms with like counts share levels
        order = np.argsort(place[term], kind="stable")
        self.row, self.group, self.level = place[term][order], group[order], level[order]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each occupied cell: group and level of its two columns, and the number of terms."""
        lo, rows = 0, STRETCH
        while lo < self.n:
            hi = min(self.n, lo + rows)
            a, b = np.searchsorted(self.row, [lo, hi])
            levels = np.zeros((hi - lo, self.groups), np.int64)
            levels[self.row[a:b] - lo, self.group[a:b]] = self.level[a:b]
            columns = [np.unique(levels[:, g], return_inverse=True) for g in range(self.groups)]
            width = np.array([len(u) for u, _ in columns])
            if width.sum() > _COLUMNS and hi - lo > _ROWS:
                rows = max(_ROWS, (hi - lo) // 2)
                continue
            first = np.cumsum(width) - width
            matrix = np.zeros((hi - lo, int(width.sum())), np.float32)
            for g, (_, code) in enumerate(columns):
                matrix[np.arange(hi - lo), first[g] + code] = 1
            of_group, of_level = np.repeat(np.arange(self.groups), width), np.concatenate([u for u, _ in columns])
            for x in range(0, matrix.shape[1], _COLUMNS):
                for y in range(x, matrix.shape[1], _COLUMNS):
                    joint = matrix[:, x : x + _COLUMNS].T @ matrix[:, y : y + _COLUMNS]
                    i, j = np.nonzero(joint)
                    n = joint[i, j].astype(np.int64)
                    i, j = i + x, j + y
                    yield of_group[i], of_level[i], of_group[j], of_level[j], n
                    if y > x:  # the product is symmetric
                        yield of_group[j], of_level[j], of_group[i], of_level[i], n
            lo = hi


def _priced(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """The sums of all pairs of groups over one stretch of terms. groups: place and price of level 0 of every group of the language."""
    groups = groups.sort_by("place")
    lang, zero = groups.column("of")[0], groups.column("zero").to_numpy()
    term = entries.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if entries.num_rows else np.empty(0, np.int64)
    group, level, p = (entries.column(c).to_numpy() for c in ("at", "n", "p"))
    group = group.astype(np.int64)
    sums = np.zeros((len(zero), len(zero)), np.int64)
    order = np.lexsort([level, group])
    keys_g, keys_l, prices = group[order], level[order], p[order]
    head = np.flatnonzero(np.diff(keys_g, prepend=-1) | np.diff(keys_l, prepend=-1)) if len(order) else np.empty(0, np.int64)
    keys_g, keys_l, prices = keys_g[head], keys_l[head], prices[head]
    start = np.searchsorted(keys_g, np.arange(len(zero) + 1))

    def price(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = zero[g].copy()
        for one in np.unique(g):
            own = np.flatnonzero((g == one) & (n > 0))
            lo, hi = start[one], start[one + 1]
            out[own] = prices[lo + np.searchsorted(keys_l[lo:hi], n[own])]
        return out

    for g, c, h, d, n in Blocks(term, group, level, len(zero)):
        p, q = price(g, c), price(h, d)
        np.add.at(sums, (g, h), n * ((p - q) * (p - q) // (p + q)))
    i, j = np.nonzero(sums)
    return pa.table([pa.repeat(lang, len(i)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], names=["lang", "at", "other", "value"])


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: how far the group lies from each other source of its language, over the terms that at least `least_docs` rows of the language hold; 0 where there are none. Part `term`:
    the `top` terms that the group has and weighs more than its language does. Ties rank by the item's bytes. Null text, lang and source count as empty strings, which are
    names like any other; a group whose texts hold no terms still has its pairs. Repeated rows count as often as they occur. Other columns are not read. An empty table gives an empty result;
    a language with one source has no pairs.
    """
    counted = count_terms(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = scratch.save(counted, "terms", codec="zstd")
    kept = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"), F.collect_list(F.struct("source", "n")).alias("own")).where(F.col("docs") >= least_docs)
    kept = scratch.save(kept.drop("docs"), "kept", codec="zstd")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    counts = kept.select("lang", F.explode("own").alias("o")).groupBy("lang", "o.source").agg(F.sum("o.n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = named.join(counts, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["total", "terms", "lang_total"]).withColumn("at", at)
    groups = scratch.save(groups, "groups")
    entries = kept.select("lang", "term", "of_lang", F.explode("own").alias("o")).select("lang", "term", "of_lang", "o.source", "o.n").join(bounded(groups), ["lang", "source"])
    entries = entries.withColumn("p", _price(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", _price(F.col("of_lang"), F.col("lang_total"), F.col("terms")))

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    shape = ["lang", "source", "part", "item", "value", F.row_number().over(by_rank).alias("rank")]
    strong = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    terms = strong.select(*shape).where(F.col("rank") <= top)

    stretches = F.ceil(F.col("terms") / STRETCH)
    dealt = entries.select("lang", F.pmod(F.xxhash64("term"), stretches).alias("stretch"), "term", "at", "n", "p")
    every = F.explode(F.sequence(F.lit(0).cast("long"), stretches - 1)).alias("of_stretch")
    wanted = groups.where("terms > 0").select(F.col("lang").alias("of"), every, F.col("at").alias("place"), _price(F.lit(0), F.col("total"), F.col("terms")).alias("zero"))
    sums = dealt.groupBy("lang", "stretch").cogroup(wanted.groupBy("of", "of_stretch")).applyInArrow(_priced, "lang string, at int, other int, value long")
    sums = sums.groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"))
    pairs = groups.select("lang", "source", "at").join(other, "lang").where(F.col("at") != F.col("other")).join(sums, ["lang", "at", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).select(*shape)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of documents: every pair within a language, and each group's ten terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op13"))


#: Every two groups of a language over its kept terms, joined plainly.
SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by all having count(distinct id) >= 10),
v as (select lang, count(*) as v from k group by all),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
t as (select lang, source, sum(n) as n from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) as p
  from g join k using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) as q
  from c join v using (lang) join (select lang, sum(n) as total from c group by all) using (lang) group by all),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q),
s as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
select * from s where part = 'pair' or rank <= 10
"""
