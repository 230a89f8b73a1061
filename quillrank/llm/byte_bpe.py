"""Operator 12: byte-level BPE over the corpus's distinct words, and back.

The texts are cut into words by the vocabulary's pattern and dealt in chunks of some megabytes. A chunk lists its distinct words and, for each place, which of
them stands there. The chunks' words meet in one shuffle by a hash, where each distinct word of the corpus is encoded once; its ids go back to all chunks that hold it
and are put together by position. Only a chunk's distinct words travel; its places wait in a file in the shared folder. So a frequent word costs a few bytes a chunk. Decoding
does the same with a chunk's distinct ids and the table of the tokens' bytes, which is no larger than the vocabulary and is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, bound_batches

CHUNK_BYTES = 8 << 20  # of text
MOST_TOKENS = 1 << 20  # of a vocabulary whose table is broadcast
_SLICE = 1 << 17  # words or ids laid out at once
_GROUP = 1 << 20  # ids that are decoded together
_ENCODINGS: dict[tuple[str, str], object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of base64 tokens with ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODINGS[path, pattern]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(codes: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: the upper planes of small numbers are nearly empty."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def cut_words(docs: DataFrame, pattern: str, folder: str, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of chunks and of their words, told apart by `bucket`.

    A chunk's row (bucket -1) has chunk, doc_ids, sizes (words of each document) and file, where its places lie. Its words have a row for each bucket that they fall into by a hash:
    start (of the words before them in the chunk), n, lengths (packed), bytes (of all words, compressed) and size. A file's name is of its own attempt, so a repeated task never meets the first one's.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, chunk = regex.compile(pattern).findall, TaskContext.get().partitionId() << 33
        keys, sizes, codes, numbers, held = [], [], [], _Numbers(), 0

        def rows() -> pa.RecordBatch:
            flat, own = np.concatenate(codes), [w.encode() for w in numbers]
            rank = np.empty(len(own), np.int32)
            rank[np.argsort(-np.bincount(flat, minlength=len(own)), kind="stable")] = np.arange(len(own))  # small numbers for frequent words
            of = np.fromiter((zlib.crc32(w) % buckets for w in own), np.int64, len(own))
            order = np.argsort(of, kind="stable")
            slot = np.empty(len(own), np.int32)
            slot[rank[order]] = np.arange(len(own))
            name = _write(folder, [_packed(slot), _packed(rank[flat] if len(flat) else flat)], [len(slot), len(flat)])
            head = np.flatnonzero(np.diff(of[order], prepend=-1))
            stop = np.append(head[1:], len(order))
            named = [own[i] for i in order.tolist()]
            length = np.fromiter(map(len, named), np.int64, len(named))
            joined = [b"".join(named[i:j]) for i, j in zip(head.tolist(), stop[: len(head)].tolist(), strict=True)]
            columns = {
                "bucket": [-1, *of[order][head].tolist()], "chunk": [chunk] * (len(head) + 1), "doc_ids": [keys, *[None] * len(head)], "sizes": [sizes, *[None] * len(head)], "file": [name, *[None] * len(head)],
                "start": [None, *head.tolist()], "n": [None, *(stop[: len(head)] - head).tolist()], "lengths": [None, *(_packed(length[i:j]) for i, j in zip(head, stop))],
                "bytes": [None, *(pa.compress(x, codec="zstd", asbytes=True) for x in joined)], "size": [None, *map(len, joined)],
            }
            return pa.record_batch([pa.array(v, _ROWS.field(k).type) for k, v in columns.items()], schema=_ROWS)

        for batch in batches:
            for one, doc in zip(batch.column("text"), batch.column("doc_id").to_pylist(), strict=True):
                raw = one.as_py() or ""
                own = find(raw)
                keys.append(doc)
                sizes.append(len(own))
                codes.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                held += len(raw)
                if held >= CHUNK_BYTES:
                    yield rows()
                    chunk, keys, sizes, codes, numbers, held = chunk + 1, [], [], [], _Numbers(), 0
        if keys:
            yield rows()

    bound_batches(docs.sparkSession)
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(cut, "bucket long, chunk long, doc_ids array<long>, sizes array<int>, file string, start long, n long, lengths binary, bytes binary, size long")


_ROWS = pa.schema([
    ("bucket", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("lengths", pa.binary()), ("bytes", pa.binary()), ("size", pa.int64()),
])


def _write(folder: str, parts: list[bytes], counts: list[int]) -> str:
    """Packed numbers in a new file; its name tells their counts and sizes."""
    store, top = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    name = "-".join(map(str, (uuid.uuid4().hex, *counts, *map(len, parts))))
    with store.open_output_stream(f"{top}/{name}") as out:
        for p in parts:
            out.write(p)
    return name


def _read(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    store, top = pyarrow.fs.FileSystem.from_uri(folder)
    a, b, first, second = map(int, name.split("-")[1:])
    with store.open_input_stream(f"{top}/{name}") as file:
        return _unpacked(pa.py_buffer(file.read(first)), a), _unpacked(pa.py_buffer(file.read(second)), b)


def encode_words(listed: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ids of the words of the rows of `cut_words`: of (the chunk), start, n, sizes (packed), ids (packed) and m, their number.

    Rows of a bucket meet in a row, and each of its words is encoded once; the pattern isn't applied again.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, now, known = _encoding(path, pattern)._encode_single_piece, None, {}
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                bucket, chunk, start, n, size = (batch.column(c)[r].as_py() for c in ("bucket", "chunk", "start", "n", "size"))
                if bucket != now:
                    now, known = bucket, {}
                raw = pa.decompress(batch.column("bytes")[r].as_buffer(), decompressed_size=size, codec="zstd", asbytes=True)
                edge = np.concatenate([[0], np.cumsum(_unpacked(batch.column("lengths")[r].as_buffer(), n), dtype=np.int64)]).tolist()
                ids = []
                for i in range(n):
                    word = raw[edge[i] : edge[i + 1]]
                    got = known.get(word)
                    if got is None:
                        known[word] = got = one(word)
                    ids.append(got)
                flat = np.array([i for x in ids for i in x], np.int64)
                out.append((chunk, start, n, _packed(np.fromiter(map(len, ids), np.int64, n)), _packed(flat), len(flat)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["of", "start", "n", "sizes_", "ids", "m"])

    met = listed.repartition("bucket").sortWithinPartitions("bucket")
    return met.select("bucket", "chunk", "start", "n", "lengths", "bytes", "size").mapInArrow(encode, "of long, start long, n long, sizes_ binary, ids binary, m long")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and the length of each."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] if at is not None and at.size else np.zeros(1, np.int32)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, np.diff(at).astype(np.int64)


def _laid_out(flat: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat, `size` long one after the other, in the order of codes, and the n + 1 edges of the result."""
    start, n = np.cumsum(size) - size, size[codes]
    edge = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start[codes] - edge[:-1], n) + np.arange(edge[-1])], edge


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of documents with about _SLICE words or ids; a larger one stands alone."""
    upto, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _SLICE, side="right")) - 1)
        yield lo, hi
        lo = hi


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and ids (little-endian unsigned 32-bit numbers) for every row of docs; only key and text are read.

    ids are those that the tiktoken library gives each match of the pattern, in a row. Null and empty texts have no ids. Rows
    with null or repeated keys, and repeated rows, are encoded each by itself. An empty table gives an empty result. A text longer than a chunk is a chunk of its own.
    """
    return _placed(docs, path, pattern, scratch, key, text, lambda chunk, table: table, ENCODED)


def _placed(docs: DataFrame, path: str, pattern: str, scratch: Scratch, key: str, text: str, finish: Callable[[int, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """What finish makes of each chunk's encoded documents."""
    spark, folder = docs.sparkSession, f"{scratch.path}/places"
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.save(cut_words(docs, pattern, folder, buckets, key, text), "words")
    met = encode_words(rows.where("bucket >= 0"), path, pattern)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("start")
        numbers = lambda name, n: [_unpacked(b.as_buffer(), k.as_py()) for b, k in zip(right.column(name), right.column(n), strict=True)]
        none = [np.empty(0, np.int64)]
        size, flat = np.concatenate(none + numbers("sizes_", "n")).astype(np.int64), np.concatenate(none + numbers("ids", "m")).astype("<u4")
        plain, edge = list(map(str, flat.tolist())), np.concatenate([[0], np.cumsum(size)]).tolist()
        texts = [",".join(plain[a:b]) + "," for a, b in zip(edge[:-1], edge[1:], strict=True)]
        keys, sums, counts, ids = [], [], [], []
        for row in range(left.num_rows):
            doc_ids, sizes = left.column("doc_ids")[row], left.column("sizes")[row].values.to_numpy().astype(np.int64)
            slot, codes = _read(folder, left.column("file")[row].as_py())
            start = np.concatenate([[0], np.cumsum(sizes)])
            keys.append(doc_ids.values)
            for lo, hi in _runs(sizes):
                own = slot[codes[start[lo] : start[hi]]]
                got, at = _laid_out(flat, size, own)
                stop = at[start[lo : hi + 1] - start[lo]]
                raw, listed = got.tobytes(), own.tolist()
                counts.append(np.diff(stop))
                for d in range(hi - lo):
                    ids.append(raw[4 * stop[d] : 4 * stop[d + 1]])
                    joined = "".join(map(texts.__getitem__, listed[start[lo + d] - start[lo] : start[lo + d + 1] - start[lo]]))
                    sums.append(hashlib.sha256(joined[:-1].encode()).hexdigest())
        columns = [pa.chunked_array(keys, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *counts])), pa.array(sums, pa.string()), pa.array(ids, pa.binary())]
        return finish(left.column("chunk")[0].as_py(), pa.table(columns, names=["doc_id", "n_tokens", "ids_sha256", "ids"]))

    whole = rows.where("bucket = -1").select("chunk", "doc_ids", "sizes", "file")
    return whole.groupBy("chunk").cogroup(met.groupBy("of")).applyInArrow(place, schema)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """id and bytes of every token of the vocabulary."""
    ranks = load_ranks(path)
    return spark.createDataFrame(pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array(list(ranks), pa.binary())], names=["id", "bytes"]))


def decode(encoded: DataFrame, tokens: DataFrame, carry: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns `carry` of encoded, and `decoded`, the bytes of its ids (little-endian unsigned 32-bit numbers); `tokens` has id and bytes, one row an id.

    Null and empty ids give no bytes. A row with an id that the table doesn't have gives null. Rows stay as many as they are; an empty table
    gives an empty result. Rows don't leave their partition: the distinct ids of some megabytes meet the broadcast table there, and a local sort brings them back behind their rows.
    """
    bound_batches(encoded.sparkSession)
    rows = encoded.select(*carry, F.col(ids).cast("binary").alias("ids"))
    kept = T.StructType([T.StructField(c, encoded.schema[c].dataType) for c in carry])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = 0, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column("ids").nbytes // 4
            if n >= _GROUP:
                yield from _split(chunk, pa.Table.from_batches(held)).to_batches()
                chunk, held, n = chunk + 1, [], 0
        if held:
            yield from _split(chunk, pa.Table.from_batches(held)).to_batches()

    return _joined(rows.mapInArrow(cut, _split_schema(kept)), tokens, kept)


def _split(chunk: int, rows: pa.Table) -> pa.Table:
    """A chunk of rows with ids as one row of what they carry and of their ids' places, and one row for each distinct id."""
    carry = [c for c in rows.column_names if c != "ids"]
    lists = rows.column("ids").combine_chunks()
    raw, sizes = _flat(lists.fill_null(b"") if lists.null_count else lists)
    flat, sizes = np.frombuffer(raw.tobytes(), "<u4"), sizes // 4
    top = int(flat.max()) + 1 if len(flat) else 0
    if top <= MOST_TOKENS:
        there = np.zeros(top, bool)
        there[flat] = True
        own, codes = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[flat]
    else:
        own, codes = np.unique(flat, return_inverse=True)
    carried = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in carry], names=carry)
    n = len(own) + 1
    first = [pa.array([chunk] * n, pa.int64()), pa.array(range(-1, n - 1), pa.int32()), pa.array([None, *own.tolist()], pa.int64())]
    payload = [pa.array([x] + [None] * (n - 1), t) for x, t in ((sizes.tolist(), pa.list_(pa.int32())), (_packed(codes), pa.binary()))]
    every = pa.ListArray.from_arrays(pa.array([0] + [rows.num_rows] * n, pa.int32()), carried)
    return pa.table([*first, *payload, every], names=["chunk", "code", "id", "sizes", "codes", "carried"])


def _split_schema(kept: T.StructType) -> T.StructType:
    kinds = (("chunk", T.LongType()), ("code", T.IntegerType()), ("id", T.LongType()), ("sizes", T.ArrayType(T.IntegerType())), ("codes", T.BinaryType()), ("carried", T.ArrayType(kept)))
    return T.StructType([T.StructField(n, t) for n, t in kinds])


def _joined(pieces: DataFrame, tokens: DataFrame, kept: T.StructType) -> DataFrame:
    """The carried columns and the bytes of the ids, from rows of `_split` whose chunks are whole within a partition."""
    if tokens.count() > MOST_TOKENS:
        raise ValueError(f"a vocabulary has at most {MOST_TOKENS} tokens here")
    carry = kept.fieldNames()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            at = [*np.flatnonzero(batch.column("code").to_numpy() < 0).tolist(), batch.num_rows]
            if held:
                held.append(batch.select(["bytes"]).slice(0, at[0]))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if head is not None:
                    yield from decoded(head, held)
                head, held = batch.slice(lo, 1), [batch.select(["bytes"]).slice(lo + 1, hi - lo - 1)]
        if head is not None:
            yield from decoded(head, held)

    def decoded(head: pa.RecordBatch, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(held).column("bytes").combine_chunks()
        strange = own.is_null().to_numpy(zero_copy_only=False)
        flat, size = _flat(own.fill_null(b"") if own.null_count else own)
        sizes, carried = head.column("sizes")[0].values.to_numpy().astype(np.int64), head.column("carried")[0].values
        codes, start = _unpacked(head.column("codes")[0].as_buffer(), int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
        for lo, hi in _runs(sizes):
            own, at = codes[start[lo] : start[hi]], start[lo : hi + 1] - start[lo]
            out, edge = _laid_out(flat, size, own)
            bad = np.concatenate([[0], np.cumsum(strange[own])])[at]
            raw, stop = out.tobytes(), edge[at]
            texts = [None if bad[i] < bad[i + 1] else raw[stop[i] : stop[i + 1]] for i in range(hi - lo)]
            yield pa.record_batch([*carried.slice(lo, hi - lo).flatten(), pa.array(texts, pa.binary())], names=[*carry, "decoded"])

    met = pieces.join(F.broadcast(tokens.withColumn("id", F.col("id").cast("long"))), "id", "left").sortWithinPartitions("chunk", "code")
    return met.select("code", "sizes", "codes", "carried", "bytes").mapInArrow(put, T.StructType([*kept.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded: encode and decode one after the other, without a Python process of its own between them."""
    kept = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())])
    return _joined(_placed(docs, path, pattern, scratch, key, text, _split, _split_schema(kept)), token_table(docs.sparkSession, path), kept)


def op12_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents encoded and decoded again, told of by digests."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN, Scratch(spark, "op12"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
