"""Operator 11: fill-in-the-middle, cut by a wavelet matrix over character classes.

A text's tokens are its words, each with the blanks before it, and the blanks at its end. Every byte gets a class of three bits: blank or not,
last of a token or not, first of a code point or not. A wavelet matrix over the classes of a few megabytes of texts answers how often a class occurs before
any byte; sums of such ranks count token ends and code points, and bisection on the former finds both cuts of all texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .storage import bound_batches

_BITS = 3
_BLANK, _LAST, _FIRST = 4, 2, 1
TOKEN_ENDS = [_LAST, _LAST | _FIRST, _BLANK | _LAST | _FIRST]
CODE_POINTS = [_FIRST, _LAST | _FIRST, _BLANK | _FIRST, _BLANK | _LAST | _FIRST]
MARKS = (b"<P>", b"<S>", b"<M>")


class WaveletMatrix:
    """Ranks in a sequence of numbers below 2**bits, by one bit vector with counted blocks of 64 for each bit."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            one = (codes >> b & 1).astype(bool)
            room = np.zeros((len(one) // 64 + 1) * 8, np.uint8)
            packed = np.packbits(one, bitorder="little")
            room[: len(packed)] = packed
            block = room.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(block), dtype=np.int64)])
            self.levels.append((block, before, len(one) - int(before[-1])))
            codes = np.concatenate([codes[~one], codes[one]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often the code occurs before each of the places."""
        lo, hi = np.zeros_like(at), at
        for b, (block, before, zeros) in zip(range(len(self.levels) - 1, -1, -1), self.levels, strict=True):
            ones = [before[x >> 6] + np.bitwise_count(block[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (lo, hi)]
            lo, hi = (zeros + ones[0], zeros + ones[1]) if code >> b & 1 else (lo - ones[0], hi - ones[1])
        return hi - lo

    def count(self, codes: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of the numbers before each place are among the codes."""
        return sum(self.rank(c, at) for c in codes)

    def place(self, codes: Sequence[int], k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest place in lo to hi with at least k numbers among the codes before it, by bisection; hi where there are fewer."""
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            enough = self.count(codes, middle) >= k
            lo, hi = np.where(open_ & ~enough, middle + 1, lo), np.where(open_ & enough, middle, hi)
        return lo


def classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each byte of the texts that lie between the offsets."""
    blank = words._SPACE[data]
    end = np.zeros(len(data), bool)
    end[at[1:][np.diff(at) > 0] - 1] = True
    before_blank = np.append(blank[1:], True) if len(data) else blank
    last = end | (~blank & before_blank)
    return (blank * np.uint8(_BLANK)) | (last * np.uint8(_LAST)) | (((data & 0xC0) != 0x80) * np.uint8(_FIRST))


def draws(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that the seed and the key decide; a null key counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output for every row of docs; only key and text are read.

    Of the texts, `percent` in 100 are cut in three at token ends drawn from the seed and the key; `suffix_first` in 100 of those begin with the suffix (form
    spm), the others with the prefix (psm). The rest stay as they are (plain), and so do empty texts and those that hold one of the marks. Null texts
    count as empty: n is 0 and the output empty. Rows with equal keys draw alike, null keys too; repeated rows stay repeated. An empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch):
                data, at = words.utf8(piece.column("text"))
                matrix = WaveletMatrix(classes(data, at), _BITS)
                lo, hi = at[:-1], at[1:]
                before = matrix.count(TOKEN_ENDS, lo)
                n = matrix.count(TOKEN_ENDS, hi) - before
                drawn = np.array([draws(seed, k) for k in piece.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
                units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
                one, two = (np.where(k > 0, matrix.place(TOKEN_ENDS, before + k, lo, hi), lo) for k in (units[:, 0], units[:, 1]))
                points = [matrix.count(CODE_POINTS, x) for x in (lo, one, two)]
                raw, rows = data.tobytes(), []
                for r in range(piece.num_rows):
                    own = raw[lo[r] : hi[r]]
                    if not own or drawn[r, 2] % 100 >= percent or any(m in own for m in MARKS):
                        rows.append(("plain", None, None, own))
                        continue
                    parts = raw[lo[r] : one[r]], raw[one[r] : two[r]], raw[two[r] : hi[r]]
                    form = "spm" if drawn[r, 3] % 100 < suffix_first else "psm"
                    out = b"<S>%b<P>%b<M>%b" % (parts[2], parts[0], parts[1]) if form == "spm" else b"<P>%b<S>%b<M>%b" % (parts[0], parts[2], parts[1])
                    rows.append((form, int(points[1][r] - points[0][r]), int(points[2][r] - points[1][r]), out))
                form, prefix, middle, out = zip(*rows, strict=True)
                columns = [pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.record_batch([piece.column("doc_id"), pa.array(n), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that fill_in_middle was given, from output and form alone; null if either is null."""
    part = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents transformed, told of by digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: Tokens by the pattern itself, cut by list slices; the text is its own restoration.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
w as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens, list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i + 7])::bigint) as x from d),
u as (select *, len(tokens) as n, least(x[1] % (len(tokens) + 1), x[2] % (len(tokens) + 1)) as a, greatest(x[1] % (len(tokens) + 1), x[2] % (len(tokens) + 1)) as b from w),
p as (
  select doc_id, n, t, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:n], '') as suffix,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 50 then 'plain' when x[4] % 100 < 80 then 'spm' else 'psm' end as form from u)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
