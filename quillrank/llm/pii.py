"""Operator 4: personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans, leftmost and non-overlapping within a kind. Validators confirm them: number ranges for ip, Luhn for card,
digit counts for phone, mod 97 for iban. Words within 40 characters adjust the score. The four base kinds (email, ip, card, phone) are kept
whatever their score; the added kinds (iban, tel, ssn) are kept from a score of 0.6 and where they touch no base span.

The patterns are possessive and anchored to the start of a run (or to the end of the match before), so that they
find what their plain forms find, in time linear in the text and without deep recursion. Positions are running sums over the matches, taken in
blocks of about the square root of their number (`scan`), and text around a span is cut from pieces of PIECE characters, so that a text with very many
matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import free_name

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "tel", "ssn")
LEAST_SCORE = 0.6
NEAR = 40
PIECE = 1000
_SPANS = "array<struct<kind:string,start:int,end:int,s:string>>"
_SCORED = "array<struct<kind:string,start:int,end:int,score:double>>"

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "tel": r"(?<![0-9A-Za-z_+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z_.-])",
    "ssn": r"(?<![0-9A-Za-z_+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_.-])",
}
#: Of a span that its validator has confirmed.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.8, "iban": 0.8, "tel": 0.4, "ssn": 0.4}
FOR = {
    "email": "mail|email|e-mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "tel": "phone|tel|call|mobile|cell|fax",
    "ssn": "ssn|social|security|insured",
}
AGAINST = {"ip": "version|release|section", "card": "isbn|order|tracking|serial", "phone": "isbn|order|serial", "tel": "isbn|order|serial|part", "ssn": "isbn|order|serial|part"}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(compact: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters move to its end and whose letters count from 10."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int"))


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$")
    if kind == "card":
        return F.when(F.length(_digits(s)).between(13, 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        compact = F.replace(s, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97(compact) == 1).otherwise(False)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)") & ~s.contains("-00-") & ~s.endswith("-0000")
    return F.lit(True)


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def scan(items: Column, step: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each item in order emit(state before it, item), an array of type `kind`; all of them in a row.

    The state is an int that starts with 0; step(state, item) gives the next one, and merge(s, step(... step(0, x) ..., y)) is what steps over x ... y make of s.
    """

    def over(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda b: F.slice(p, b * width + 1, width))
        return F.when(F.size(p) > 0, _let(blocks, each)).otherwise(_empty(kind))

    def each(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
        first = F.struct(F.lit(0).alias("at"), _empty("array<int>").alias("all"))
        starts = F.aggregate(totals, first, lambda a, t: F.struct(merge(a["at"], t).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

        def one(block: Column, start: Column) -> Column:
            none = F.struct(start.alias("at"), _empty(kind).alias("all"))
            return F.aggregate(block, none, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["all"], emit(a["at"], x)).alias("all")), lambda a: a["all"])

        return F.flatten(F.zip_with(blocks, starts, one))

    return _let(items, over)


def _spans(text: Column, kind: str) -> Column:
    """The kind's confirmed spans in order, as array<struct<kind, start, end, s>>; positions count characters."""
    pattern = PATTERNS[kind]
    pairs = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("n"), h.alias("h"))),
        lambda x: x["h"].isNotNull(),
    )

    def emit(at: Column, x: Column) -> Column:
        start = at + x["g"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["h"].alias("s")))
        return F.when(_valid(kind, x["h"]), span).otherwise(_empty(_SPANS))

    found = scan(pairs, lambda at, x: at + x["g"] + x["n"], lambda a, b: a + b, emit, _SPANS)
    return F.when(text.rlike(pattern), found).otherwise(_empty(_SPANS))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, from the pieces that hold them."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substr(held, start - first * PIECE + 1, end - start)).otherwise("")


def _scored(pieces: Column, spans: Column, kind: str) -> Column:
    def score(x: Column) -> Column:
        before, after = _cut(pieces, F.greatest(x["start"] - NEAR, F.lit(0)), x["start"]), _cut(pieces, x["end"], x["end"] + NEAR)
        near = F.concat_ws(" ", before, after)
        gain = F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{FOR[kind]})(?![A-Za-z])"), 0.3).otherwise(0.0)
        loss = F.when(near.rlike(rf"(?i)(?<![A-Za-z])(?:{AGAINST[kind]})(?![A-Za-z])"), 0.3).otherwise(0.0) if kind in AGAINST else F.lit(0.0)
        value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + gain - loss)), 2)
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value.alias("score"))

    return F.transform(spans, score)


def _free(added: Column, base: Column) -> Column:
    """Those spans of `added` that touch no span of `base`, in order of start."""
    mark = lambda x, own: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x["kind"].alias("kind"))
    both = F.sort_array(F.concat(F.transform(added, lambda x: mark(x, True)), F.transform(base, lambda x: mark(x, False))))
    kind = "array<struct<start:int,end:int,own:boolean,kind:string>>"
    largest = lambda a, b: F.greatest(a, b)

    def clear(blocked: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda at, x: F.when(x["own"] & blocked(at, x), _empty(kind)).otherwise(F.array(x))

    # Forwards, the state is the largest end of a base span so far; backwards, the smallest start, held as its distance below a large number.
    top = (1 << 31) - 1
    once = scan(both, lambda at, x: F.when(x["own"], at).otherwise(F.greatest(at, x["end"])), largest, clear(lambda at, x: at > x["start"]), kind)
    twice = scan(F.reverse(once), lambda at, x: F.when(x["own"], at).otherwise(F.greatest(at, F.lit(top) - x["start"])), largest, clear(lambda at, x: F.lit(top) - at < x["end"]), kind)
    return F.filter(F.reverse(twice), lambda x: x["own"])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `pii`, array<struct<kind, start, end, score>>, ordered by kind as listed in BASE + ADDED and then by start.

    Positions are in characters, the end exclusive. A null or empty text has no spans; rows are handled one by one, so ties, repeated rows and an
    empty table need no rule. A column named `pii` is replaced; all others are kept.
    """
    kept = [c for c in docs.columns if c.lower() != "pii"]
    base, added, free, pieces = (free_name(docs, n) for n in ("base", "added", "free", "pieces"))
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]{3}")
    found = docs.withColumn(base, F.array(*[_spans(t, k) for k in BASE]))
    found = found.withColumn(added, F.flatten(F.array(*[F.when(digit, _spans(t, k)).otherwise(_empty(_SPANS)) for k in ADDED])))
    some_base, some_added = F.size(F.flatten(base)) > 0, F.size(added) > 0
    slim = F.transform(F.col(added), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("own"), x["kind"].alias("kind")))
    found = found.withColumn(free, F.when(some_added & some_base, _free(F.col(added), F.flatten(base))).otherwise(slim)).withColumn(pieces, F.when(some_added | some_base, _pieces(t)))
    parts = [_scored(F.col(pieces), F.col(base)[i], k) for i, k in enumerate(BASE)]
    of = lambda k: F.filter(free, lambda x: x["kind"] == k)
    parts += [F.filter(_scored(F.col(pieces), of(k), k), lambda x: x["score"] >= LEAST_SCORE) for k in ADDED]
    return found.select(*[F.col(f"`{c}`") for c in kept], F.when(some_base | some_added, F.concat(*parts)).otherwise(_empty(_SCORED)).alias("pii"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of `pii` in the text by its kind in angle brackets; of overlapping spans, the first to start names the whole.

    A null text stays null. All columns are kept.
    """
    pieces = free_name(docs, "pieces")
    spans = F.sort_array(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    kind = "array<struct<after:int,start:int,kind:string>>"

    def emit(at: Column, x: Column) -> Column:
        return F.when(x["start"] < at, _empty(kind)).otherwise(F.array(F.struct(at.alias("after"), x["start"].alias("start"), x["kind"].alias("kind"))))

    kept = scan(spans, lambda at, x: F.greatest(at, -x["end"]), lambda a, b: F.greatest(a, b), emit, kind)
    named = F.transform(kept, lambda x: F.concat(_cut(F.col(pieces), x["after"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    last = F.array_max(F.transform("pii", lambda x: x["end"]))
    done = F.concat(F.array_join(named, ""), _cut(F.col(pieces), last, F.length(text)))
    some = F.size("pii") > 0
    return docs.withColumn(pieces, F.when(some, _pieces(F.col(text)))).withColumn(text, F.when(some, done).otherwise(F.col(text))).drop(pieces)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CHECK = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(s, '.'), lambda p: coalesce(try_cast(p as hugeint), 999) <= 255))",
    "card": "length(regexp_replace(s, '[^0-9]', '', 'g')) between 13 and 19 and list_sum(list_transform(string_split(reverse(regexp_replace(s, '[^0-9]', '', 'g')), ''), lambda c, i: case when i % 2 = 1 then c::int when c::int > 4 then 2 * c::int - 9 else 2 * c::int end)) % 10 = 0",
    "phone": "length(regexp_replace(s, '[^0-9]', '', 'g')) between 9 and 15",
}
#: Base spans by another route: plain patterns and list arithmetic. The test tables hold none of the added kinds, for which tests/llm has its own cases.
SQL = (
    "with t as (select doc_id, coalesce(text, '') as text from documents), "
    + ", ".join(
        f"h{n} as (select doc_id, {n} as n, '{k}' as kind, g, h, unnest(generate_series(1, len(h))) as i from (select doc_id, string_split_regex(text, '{_PLAIN[k]}') as g, regexp_extract_all(text, '{_PLAIN[k]}') as h from t where regexp_matches(text, '{_PLAIN[k]}')))"
        f", s{n} as (select doc_id, n, kind, h[i] as s, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as a from h{n})"
        f", k{n} as (select doc_id, n, kind, a::bigint as a, (a + length(s))::bigint as e from s{n} where {_CHECK[k]})"
        for n, k in enumerate(BASE)
    )
    + ", u as ("
    + " union all ".join(f"select * from k{n}" for n in range(4))
    + "), j as (select doc_id, string_agg(kind || ':' || a || ':' || e, ',' order by n, a) as spans, "
    + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    + " from u group by doc_id) select t.doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)
    + ", sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from t left join j using (doc_id)"
)
