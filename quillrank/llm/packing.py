"""Operator 5: packing by powers of two.

Every document is cut into pieces whose lengths are powers of two, as many of the longest as fit and then the binary digits of the rest,
longest first. A piece is a sequence of its own: no sequence crosses documents and none is padded. Sequences of equal length are numbered in a row,
so a trainer takes fixed-shape batches from each length's stretch. The sequences are written with their ids to the shared folder, one folder for each length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens, words
from .storage import Scratch

PART_BYTES = 64 << 20  # of ids and row overhead that one task orders and writes
_ROW_BYTES = 128


def pieces_of(n: int, longest: int) -> list[int]:
    """The lengths of a document's pieces, in order: n as a sum of powers of two up to `longest`, itself a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids, little-endian unsigned integers of `width` bytes, 2 where the vocabulary allows.

    Only key and text are read. A null text counts as empty and gives one piece, its end id. Null keys and repeated rows
    are cut like any others. An empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        width = np.dtype(encode.dtype).itemsize
        kind = f"<u{width}"
        for batch in batches:
            for some in words.pieces(batch):
                ids, edge = encode.encode(some.column("text"))
                keys, starts, lengths, sums, totals, own = [], [], [], [], [], []
                for r, doc in enumerate(some.column("doc_id").to_pylist()):
                    flat = np.append(ids[edge[r] : edge[r + 1]], encode.dtype(end_id)).astype("<u4")
                    raw, slim, at = memoryview(flat).cast("B"), flat.astype(kind).tobytes(), 0
                    for n in pieces_of(len(flat), longest):
                        keys.append(doc)
                        starts.append(at)
                        lengths.append(n)
                        own.append(slim[width * at : width * (at + n)])
                        sums.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        totals.append(len(flat))
                        at += n
                columns = [pa.array(x, pa.int64()) for x in (keys, starts, lengths, sums, totals)]
                yield pa.record_batch([*columns, pa.array([width] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "width", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, width int, ids binary")


def write_sequences(pieces: DataFrame, counts: dict[int, int], scratch: Scratch) -> DataFrame:
    """Writes the pieces with their ids, a folder for each length, and returns the written rows with part and row.

    Within a length, parts and the rows of each are in order of document and start; repeated documents give repeated pieces. Each length is dealt by
    ranges of its own, in as many parts as its ids need, since all its rows are equally large.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("start"), F.asc("ids_crc32")]
    ranges = []
    for length, n in sorted(counts.items(), reverse=True):
        parts = -(-n * (4 * length + _ROW_BYTES) // PART_BYTES)
        ranges.append(pieces.where(F.col("length") == length).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    placed = reduce(DataFrame.unionAll, ranges or [pieces]).withColumn("_at", at)
    part, row = F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    rows = placed.select("doc_id", "start", "doc_tokens", "width", "ids", part, row, "length").sortWithinPartitions("length", "part", "row")
    return scratch.save(rows, "sequences", by=["length"], codec="zstd")


def number_sequences(written: DataFrame) -> DataFrame:
    """Adds sequence_id (longest sequences first, gapless over the whole corpus) from one row of totals for each written part."""
    before = Window.orderBy(F.desc("length"), F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))  # a part may hold several lengths in a row
    first = sizes.select("length", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("first"))
    return written.join(F.broadcast(first), ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("row"))


def read_sequences(numbered: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (always 0) and, with `with_ids`, the ids.

    Length, checksum and ids are taken from the ids as written.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.pieces(batch, "ids"):
                own = [np.frombuffer(b.as_buffer(), f"<u{w}").astype("<u4") for b, w in zip(some.column("ids"), some.column("width").to_pylist(), strict=True)]
                lengths, sums = pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())
                doc, start, total, at = (some.column(c) for c in ("doc_id", "start", "doc_tokens", "sequence_id"))
                columns = [doc, start, lengths, sums, total, at, pa.array(np.zeros(len(own), np.int64))]
                if with_ids:
                    columns.append(pa.array([x.view(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=names)

    return numbered.select("doc_id", "start", "doc_tokens", "sequence_id", "width", "ids").mapInArrow(read, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, longest: int = 4096, with_ids: bool = True) -> DataFrame:
    """The packed sequences of docs, read from the shared folder; see `read_sequences`.

    The pieces are written once before they are ordered, as range partitioning reads its input twice.
    """
    pieces = scratch.save(cut_documents(docs, tokenizer, end_id, longest), "pieces", by=["length"], codec="zstd")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each power of two
    written = write_sequences(pieces, counts, scratch)
    scratch.drop(pieces)
    return read_sequences(number_sequences(written), with_ids)


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, told of by what was written: the ids themselves stay in the shared folder."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 2, Scratch(spark, "op5"), with_ids=False)
