"""Connected components of a link table by union-find in Spark tasks and star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, join_one

LINKS_A_TASK = 250_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition; gives each node that isn't its group's smallest a link to that one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    found = [(x, r) for x in list(up) if (r := root(x)) != x]
    for lo in range(0, len(found), 50_000):
        nodes, roots = zip(*found[lo : lo + 50_000], strict=True)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
    least = scratch.save(least, "least")
    joined = join_one(both, least, "a", "degree")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links (a, b long) that isn't the smallest of its component.

    Tasks take LINKS_A_TASK links each, dealt by both ends, so that a node with many links is spread over tasks. Star contractions follow until nothing
    changes; links that fit in one task are done after it. Nulls link nothing. Repeated links and loops do no harm. No links give an empty table.
    """
    clean = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    parts = max(1, -(-clean.count() // LINKS_A_TASK))
    dealt = clean.repartition(parts, "a", "b") if parts > 1 else clean.repartition(1)
    now = scratch.save(dealt.mapInArrow(_local, "a long, b long"), "stars")
    state = None
    while parts > 1:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        old, wide = now, scratch.save(_star(now, True, scratch), "wide")
        now = scratch.save(_star(wide, False, scratch), "stars")
        scratch.drop(old)
        scratch.drop(wide)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
