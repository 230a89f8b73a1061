"""Operator 6: near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the whole set and the band keys of its SuperMinHash signature. One pass, no shuffle.
2. Texts with equal sets form a class at once; from here on only the class's smallest document takes part.
3. Documents that share a band key are candidates. A bucket isn't expanded into its pairs: its members are first held against
   one member and grouped, then those outside the bucket's largest group against another member of that group.
   A bucket whose members are by then in one group needs no more.
4. In the other buckets, what isn't in the largest group is held against all that is in another group, so
   that no link between candidates of different groups is left untested: small buckets pair by pair, large ones by blocks of
   documents, whose common shingles are counted as a matrix product.
5. Every link is confirmed on the full sets. Groups are the connected components of the links.

With 32 bands of 6 rows, a pair of similarity 0.85 shares no band with probability 3e-7, one of 0.8 with 6e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .groups import components
from .storage import Scratch, bounded, join_one
from .superminhash import bands, signatures

BANDS, ROWS = 32, 6
LARGE = 48  # members of a bucket, from which it is compared by blocks
BLOCK, BLOCK_SHINGLES = 128, 500_000  # documents, and shingles, of a block on average
HUB = 2_000  # pairs of one document that a task takes
MOST_BROADCAST = 2_000_000  # ids of candidates: 16 MB


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, in a row, with their edges."""
    found, edge = words.row_shingles(column, k)
    own = [np.unique(found[edge[i] : edge[i + 1]]) for i in range(len(edge) - 1)]
    return np.concatenate(own) if own else found, np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of docs (doc_id, text); a text without words has a null digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.pieces(batch, most=1 << 19):
                flat, edge = _sets(some.column("text"), k)
                n = np.diff(edge)
                keys = bands(signatures(flat, edge, BANDS * ROWS), ROWS)
                digest = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(edge[:-1], edge[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.record_batch([some.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[n > 0].reshape(-1)))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.pieces(batch):
                flat, edge = _sets(some.column("text"), k)
                yield pa.record_batch([some.column("doc_id"), pa.array([flat[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    joined = _with_sets(_with_sets(pairs, left, "a", "b"), right, "b", "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """Joins the sets of one end of the pairs. Those of documents with more than HUB pairs are copied, a copy for HUB pairs, so that no task gets them all."""
    hubs = pairs.groupBy(end).count().where(F.col("count") > HUB).select(end, F.ceil(F.col("count") / HUB).cast("int").alias("parts"))
    hubs = bounded(hubs)
    dealt = pairs.join(hubs, end, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")).drop("parts")
    copies = sets.join(hubs, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return dealt.join(copies, [end, "part"]).drop("part")


def _alike_in_size(percent: int):  # noqa: ANN202
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id and kept for every row of docs; other columns are ignored.

    Two documents are linked if 100 * common shingles >= percent * all shingles of both. component_id is the smallest doc_id that links lead to, kept
    tells whether that is the document itself. Without words (null text included) a document is linked with nothing. Rows without a key are linked
    with nothing and kept, with a null component_id. Rows that repeat a key count as one document with all their texts' links;
    all are returned, and all are kept if the key is. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = scratch.save(sketch(rows, k), "signatures")
    some = sig.where("doc_id is not null and digest is not null")
    classes = scratch.save(some.groupBy("digest").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands")).alias("c"), F.count(F.lit(1)).alias("copies")).select("digest", "copies", F.col("c.doc_id").alias("rep"), "c.n", "c.bands"), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = scratch.save(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = scratch.save(join_one(buckets, shared, "bucket", "size"), "members")

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    few = wanted.count()
    if few == 0:
        labels = scratch.save(members.select(F.col("rep").alias("node"), F.col("rep").alias("component")), "labels")
    else:
        wanted = F.broadcast(wanted) if few <= MOST_BROADCAST else wanted
        sets = scratch.save(_full_sets(rows.join(wanted, "doc_id", "left_semi"), k).distinct(), "sets")
        labels = _grouped(members, sets, scratch, percent)
    by_class = classes.select("digest", "copies", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component"))
    slim = sig.select("doc_id", "n_shingles", "digest")
    found = join_one(slim.where("doc_id is not null and digest is not null"), scratch.save(by_class, "by_class"), "digest", "copies").select("doc_id", "n_shingles", "component")
    out = found.unionByName(slim.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _grouped(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(node, component) from the buckets' members (bucket, rep, n, size)."""
    start = members.withColumn("comp", F.col("rep"))
    links = scratch.save(_confirm(scratch.save(_to_one(start, scratch, percent).distinct(), "pairs"), sets, percent), "links")
    left = _unsettled(members, components(links, scratch), scratch)
    if not left.isEmpty():
        pairs = scratch.save(_to_largest(left, scratch, percent).distinct(), "pairs")
        links = scratch.save(links.unionByName(_confirm(pairs, sets, percent)), "links")
        left = _unsettled(left.select("bucket", "rep", "n", "size"), components(links, scratch), scratch)
    if not left.isEmpty():
        small, large = left.where(F.col("size") < LARGE), left.where(F.col("size") >= LARGE)
        pairs = scratch.save(_across(small, percent).distinct(), "pairs")
        links = links.unionByName(_confirm(pairs, sets, percent))
        if not large.isEmpty():
            links = links.unionByName(_by_blocks(large, sets, scratch, percent))
        links = scratch.save(links, "links")
    return components(links, scratch)


def _unsettled(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of buckets that hold several groups, with comp and the bucket's largest group, main."""
    joined = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    joined = scratch.save(joined, "labelled")
    groups = joined.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    mixed = groups.groupBy("bucket").agg(F.sum("n_comp").alias("size"), F.max(F.struct("n_comp", "comp")).alias("top")).where("top.n_comp < size")
    mixed = scratch.save(mixed.select("bucket", "size", F.col("top.comp").alias("main")), "mixed")
    return scratch.save(join_one(joined.drop("size"), mixed, "bucket", "size"), "unsettled")


def _with_one(members: DataFrame, ones: DataFrame, percent: int) -> DataFrame:
    met = join_one(members.drop("size"), ones, "bucket", "size")
    return met.where((F.col("comp") != F.col("of")) & _alike_in_size(percent)).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))


def _drawn(members: DataFrame, scratch: Scratch, *draw: str) -> DataFrame:
    """One member of each bucket, by a hash of the columns `draw`."""
    row = F.struct(F.xxhash64(*draw).alias("draw"), F.col("rep").alias("a"), F.col("n").alias("m"), F.col("comp").alias("of"))
    return scratch.save(members.groupBy("bucket").agg(F.min(row).alias("one"), F.max("size").alias("size")).select("bucket", "size", "one.a", "one.m", "one.of"), "drawn")


def _to_one(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Each member of a bucket with one of them. Buckets with the same members draw the same one, so few pairs are different."""
    return _with_one(members, _drawn(members, scratch, "rep"), percent)


def _to_largest(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Each member outside its bucket's largest group with one in it, another one in each bucket."""
    return _with_one(members.where("comp <> main"), _drawn(members.where("comp = main"), scratch, "rep", "bucket"), percent)


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Each member outside its bucket's largest group with the bucket's members of other groups; for small buckets."""
    outside = members.where("comp <> main").select("bucket", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("comp").alias("of"))
    fits = (F.col("comp") != F.col("of")) & _alike_in_size(percent) & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("rep")))
    return outside.join(members, "bucket").where(fits).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))


def _by_blocks(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The links between members outside their bucket's largest group and those of other groups, found block by block.

    Blocks have BLOCK documents and BLOCK_SHINGLES shingles on average, fewer in small buckets. The pairs of blocks are listed and dealt by both blocks before
    the sets are attached, so that no bucket's pairs gather in one task.
    """
    cut = members.groupBy("bucket").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("size")).select("bucket", "size", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).alias("blocks"))
    cut = scratch.save(cut, "cut")
    rows = scratch.save(join_one(members.drop("size"), cut, "bucket", "size").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks"), "blocked")
    doc = F.collect_list(F.struct("rep", "comp", "shingles"))
    held = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    outside = held.where("comp <> main").groupBy("bucket", F.col("block").alias("i")).agg(doc.alias("x"))
    every = held.groupBy("bucket", F.col("block").alias("j")).agg(doc.alias("y"))
    firsts = rows.where("comp <> main").select("bucket", F.col("block").alias("i")).distinct()
    listed = firsts.join(rows.select("bucket", F.col("block").alias("j")).distinct(), "bucket")
    joined = listed.join(outside, ["bucket", "i"]).join(every, ["bucket", "j"]).select("x", "y")

    def flat(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        docs = column[i].values
        rep, comp, data = (docs.field(f) for f in ("rep", "comp", "shingles"))
        each = [np.frombuffer(d.as_buffer(), np.uint64) for d in data]
        return rep.to_numpy(), comp.to_numpy(), np.concatenate(each), np.array([len(e) for e in each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, a_of, x, n), (b, b_of, y, m) = flat(batch.column("x"), i), flat(batch.column("y"), i)
                r, c = np.nonzero(_linked(x, n, y, m, percent) & (a_of[:, None] != b_of[None, :]))
                if len(r):
                    yield pa.record_batch([pa.array(np.minimum(a[r], b[c])), pa.array(np.maximum(a[r], b[c]))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _linked(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of x (sizes n, in a row) and y (sizes m) are similar enough, by the counts of their common members."""
    shared = np.intersect1d(x, y)
    rows = []
    for flat, size in ((x, n), (y, m)):
        spot = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[spot] == flat if len(shared) else np.zeros(len(flat), bool)
        rows.append((np.repeat(np.arange(len(size)), size)[hit], spot[hit]))
    common = np.zeros((len(n), len(m)), np.float32)
    for lo in range(0, len(shared), 8192):
        parts = []
        for (owner, at), size in zip(rows, (n, m), strict=True):
            some = (at >= lo) & (at < lo + 8192)
            part = np.zeros((len(size), min(8192, len(shared) - lo)), np.float32)
            part[owner[some], at[some] - lo] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    common = common.astype(np.int64)
    return 100 * common >= percent * (n[:, None] + m[None, :] - common)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op6"), percent=85, k=3)


SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) < 3 then list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from w),
n as (select doc_id, len(s)::bigint as n_shingles from s),
e as (select doc_id, unnest(s) as sh from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r(id, root) as (
  select doc_id, doc_id from n
  union
  select m.b, r.root from r join (select a, b from l union all select b, a from l) m on m.a = r.id)
select n.doc_id, n_shingles, min(root) as component_id, n.doc_id = min(root) as kept from n join r on r.id = n.doc_id group by n.doc_id, n_shingles
"""
