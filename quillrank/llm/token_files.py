"""Operator 3: token ids in Arrow files of equal-length sequences.

Each part of the corpus becomes one Arrow file (the stream format between two magic numbers, with a footer that says where each
batch begins). Its columns are `ids`, a fixed-size list of the smallest unsigned type that holds the vocabulary, and `mask`, a
fixed-size list of booleans that is false on the padding at the file's end. Rows are equally long and uncompressed,
so any sequence of a memory-mapped file is found by arithmetic and used without a copy. Beside it lies an Arrow file
of the documents (doc_id, start in the file, n_tokens).

Parts are ranges of the key, so the files in name order hold the corpus in ascending key order. A task writes under a
name of its own attempt and renames at the end; a repeated task replaces the file by one of the same bytes. An attempt that fails
removes what it wrote; one whose process is killed may leave a file named `_attempt-`, which no reader looks at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens, words
from .storage import Scratch, bound_batches

_BATCH_ROWS = 64


class _Writer:
    """Fills equal-length rows from a stream of ids and writes them in batches."""

    def __init__(self, sink: pa.NativeFile, length: int, kind: np.dtype) -> None:
        self.length, self.kind = length, kind
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file, self.held, self.n_held, self.total = pa.ipc.new_file(sink, schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        whole = self.length * _BATCH_ROWS
        if self.n_held >= whole:
            flat = np.concatenate(self.held)
            for lo in range(0, len(flat) - whole + 1, whole):
                self._write(flat[lo : lo + whole], whole)
            self.held = [flat[len(flat) // whole * whole :].copy()]
            self.n_held = len(self.held[0])

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.file_schema(columns)))

    @staticmethod
    def file_schema(columns: list[pa.Array]) -> pa.Schema:
        return pa.schema([("ids", columns[0].type), ("mask", columns[1].type)])

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            room = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            room[: len(flat)] = flat
            self._write(room, len(flat))
        self.file.close()


def settle(store: pyarrow.fs.FileSystem, own: str, name: str) -> None:
    """Renames an attempt's file. File systems that don't rename onto a file, as HDFS, get the earlier attempt's one out of the way first."""
    try:
        store.move(own, name)
    except OSError:
        if store.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            raise
        store.delete_file(name)
        store.move(own, name)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as token files in `folder` and returns the plan whose rows tell of each file: part, n_docs, n_tokens.

    Only key and text are read. A null text counts as empty and gets its end id only; null keys come first; repeated
    rows are written as often as they occur, ordered by a hash of the text and then the text where keys are equal, so that ranges can part them. An empty table gives no file. `folder` is any place that pyarrow's file systems reach.
    The files are written when the result is evaluated.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, own = f"{top}/part-{part:06d}", f"{top}/_attempt-{part:06d}-{task.taskAttemptId()}"
        try:
            yield from fill(batches, store, part, name, own)
        except BaseException:
            for kind in ("ids", "docs"):
                if store.get_file_info(f"{own}.{kind}").type != pyarrow.fs.FileType.NotFound:
                    store.delete_file(f"{own}.{kind}")
            raise

    def fill(batches: Iterator[pa.RecordBatch], store: pyarrow.fs.FileSystem, part: int, name: str, own: str) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        keys, sizes, writer, sink = [], [], None, None
        for batch in batches:
            for piece in words.pieces(batch):
                if writer is None:
                    sink = store.open_output_stream(f"{own}.ids")
                    writer = _Writer(sink, length, np.dtype(encode.dtype))
                ids, edge = encode.encode(piece.column("text"))
                out = np.full(len(ids) + len(edge) - 1, end_id, encode.dtype)
                real = np.ones(len(out), bool)
                real[edge[1:] + np.arange(len(edge) - 1)] = False
                out[real] = ids
                writer.add(out)
                keys.append(piece.column("doc_id"))
                sizes.append(np.diff(edge) + 1)
        if writer is None:
            return
        writer.close()
        sink.close()
        sizes = np.concatenate(sizes)
        index = pa.table([pa.chunked_array(keys), np.cumsum(sizes) - sizes, sizes], names=["doc_id", "start", "n_tokens"])
        with store.open_output_stream(f"{own}.docs") as sink, pa.ipc.new_file(sink, index.schema) as file:
            file.write_table(index, 100_000)
        for kind in ("ids", "docs"):
            settle(store, f"{own}.{kind}", f"{name}.{kind}")
        yield pa.record_batch([pa.array([part]), pa.array([len(sizes)]), pa.array([writer.total])], names=["part", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.asc_nulls_first("text")]
    return rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(write, "part long, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files that `files` (as returned by the writer) lists.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32, the checksum of its ids as little-endian
    unsigned 32-bit integers. Every file is read by a task of its own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{top}/part-{row['part']:06d}"
                yield from _documents(_open(store, f"{name}.ids"), pa.ipc.open_file(_open(store, f"{name}.docs")), row["before"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    top = files.agg(F.max("part")).first()[0]
    return listed.select(F.col("part").cast("int"), "before").repartitionById((top or 0) + 1, F.col("part")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _open(store: pyarrow.fs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(store, pyarrow.fs.LocalFileSystem) else store.open_input_file(path)


def sequence(file: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of the i-th sequence of an open file, without a copy of the ids."""
    batch = file.get_batch(i // _BATCH_ROWS)
    row = i % _BATCH_ROWS
    return batch.column("ids")[row].values.to_numpy(zero_copy_only=True), batch.column("mask")[row].values


def _documents(source: pa.NativeFile, index: pa.ipc.RecordBatchFileReader, before: int) -> Iterator[pa.RecordBatch]:
    file = pa.ipc.open_file(source)
    batches = (file.get_batch(i).column("ids").flatten().to_numpy() for i in range(file.num_record_batches))
    flat, at = np.empty(0, np.uint8), 0
    for i in range(index.num_record_batches):
        docs = index.get_batch(i)
        sums = []
        for n in docs.column("n_tokens").to_pylist():
            crc = 0
            while True:
                some = flat[at : at + n]
                crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                at, n = at + len(some), n - len(some)
                if not n:
                    break
                flat, at = next(batches), 0
            sums.append(crc)
        start = docs.column("start").to_numpy() + before
        yield pa.record_batch([docs.column("doc_id"), pa.array(start), docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, encoded, written as token files and read back."""
    import public_tokenizers

    scratch = Scratch(spark, "op3")
    folder = f"{scratch.path}/files"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = scratch.save(write_token_files(docs, folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1), "manifest")
    return read_token_files(files, folder)
