"""Operator 8: contiguous shards of near equal bytes by global prefix sums.

Rows in ascending key order form one long tape of bytes. A shard is the stretch of the tape between two equal cuts,
so shards are contiguous in the key, and a shard's bytes differ from the target by less than one row at either end.
The prefix sums come from per-partition totals; only the slim columns (key, size, checksum) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_prefix
from .storage import Scratch

LAW = "bytes"


def assign_shards(docs: DataFrame, shards: int, scratch: Scratch, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Returns key, size, text_crc32, law, shard, slot and grown_shard for every row of docs; other columns are ignored.

    size is the text's UTF-8 bytes plus `overhead`; a null text has no bytes and the checksum of an empty one (0). The row whose
    middle byte lies in the i-th of `shards` equal stretches goes to shard i, so a row longer than a stretch leaves
    neighbouring shards empty. Null keys come first; rows with the same key are ordered by size, then checksum,
    and repeated rows each get a slot of their own. An empty table gives an empty result. The law is `bytes`, so
    a change of the shard count moves rows and grown_shard is null. Equal texts are not kept together: with a third
    of the rows in one group of copies, no balanced law could do that.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    order = [F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("text_crc32")]
    placed = with_prefix(rows, order, scratch, "size")
    middle = (2 * F.col("size_at") + F.col("size")).cast("decimal(26,0)") * F.lit(shards).cast("decimal(10,0)")
    shard = F.floor(F.try_divide(middle, 2 * F.col("size_all").cast("decimal(26,0)")))
    placed = scratch.save(placed.withColumn("shard", F.least(F.coalesce(shard, F.lit(0)), F.lit(shards - 1)).cast("int")).drop("size_at", "size_all"), "placed")
    first = placed.groupBy("shard").agg(F.min("row_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("row_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40, Scratch(spark, "op8"))


#: The checksum's table from its generator polynomial, the checksum byte by byte, and prefix sums over all rows.
SQL = """
with t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, n: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, length(h) // 2 as n, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint) as bytes from d),
c as (
  select doc_id, (n + 16)::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c // 256, tab[1 + xor(c, x) % 256])), 4294967295)::bigint as text_crc32
  from b cross join t),
w as (select *, sum(size) over (order by doc_id, size, text_crc32 rows unbounded preceding) - size as before, sum(size) over () as total from c),
s as (select *, least(39, ((2 * before + size) * 40) // (2 * total))::int as shard from w)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot, null::int as grown_shard from s
"""
