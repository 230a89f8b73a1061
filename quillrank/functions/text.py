"""Text and number primitives as Spark columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = (
    "the and for with from that this are was will can has have been not but all any its our "
    "their they who what when where how via per new use may also such than more into about "
    "both each would could should through which"
).split()
#: Topics and the phrases that stand for them.
SYNONYMS = {
    "maternal health": ["pregnancy care", "birth outcomes", "birth equity", "prenatal", "maternal mortality", "obstetric"],
    "workforce development": ["job training", "career readiness", "employment training", "vocational", "job placement", "workforce"],
    "small business": ["entrepreneurship", "founder support", "startup", "entrepreneur", "sme", "micro-enterprise"],
    "community development": ["neighborhood revitalization", "community revitalization", "place-based", "community organizing"],
    "public health": ["health equity", "health education", "population health", "community health", "preventive health"],
    "climate": ["climate change", "sustainability", "environmental justice", "clean energy", "greenhouse", "renewable"],
    "education": ["literacy", "learning", "academic", "stem", "tutoring", "school", "student"],
    "housing": ["affordable housing", "shelter", "homelessness", "housing stability", "home ownership"],
    "food security": ["hunger", "nutrition", "food access", "food insecurity", "food bank"],
    "mental health": ["behavioral health", "substance abuse", "addiction", "counseling", "therapy"],
    "research": ["study", "investigation", "analysis", "evaluation", "assessment", "science"],
    "technology": ["digital", "innovation", "software", "data", "ai", "artificial intelligence"],
}


def strings(values: list[str] | tuple[str, ...]) -> Column:
    """A literal array of strings; a long one is split from one literal, which the optimizer does once."""
    if len(values) > 8:
        return F.split(F.lit("\x1f".join(values)), "\x1f")
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def table(rows: list | dict, kind: str) -> Column:
    """A literal of any kind, read once by the optimizer from one JSON literal: plans stay small however long the table."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def js_round(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def raw_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; any other character and any Unicode blank separates."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def tokenize(text: Column) -> Column:
    """Tokens of three characters or more, repeated ones included."""
    return F.filter(raw_tokens(text), lambda t: F.length(t) > 2)


def topic_tokens(text: Column) -> Column:
    """As `tokenize`, without stop words."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def flat_tokens(texts: Column, split=tokenize) -> Column:  # noqa: ANN001
    """The tokens of each string of an array, in a row."""
    return F.flatten(F.transform(texts, split))


def all_in(wanted: list[str], tokens: Column) -> Column:
    return F.size(F.array_except(strings(wanted), tokens)) == 0


def plain_topic_tokens(text: str) -> list[str]:
    """`topic_tokens` of a parameter, on the driver."""
    import re

    return [t for t in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(t) > 2 and t not in STOPWORDS]


def expand_synonyms(tokens: Column, groups: dict[str, list[str]] = SYNONYMS) -> Column:
    """Adds all tokens of each group of which the topic's or one phrase's tokens are all present; repeated tokens are dropped."""

    def added(known: Column) -> Column:
        every = {topic: list(dict.fromkeys(t for p in [topic, *phrases] for t in plain_topic_tokens(p))) for topic, phrases in groups.items()}
        return F.concat(strings([]), *[F.when(group_present(known, topic, phrases), strings(every[topic])).otherwise(strings([])) for topic, phrases in groups.items()])

    return F.array_distinct(F.concat(tokens, let(in_groups(tokens, groups), added)))


def groups_present(tokens: Column, groups: dict[str, list[str]] = SYNONYMS) -> Column:
    """The topics whose groups are present, in their order."""
    return let(in_groups(tokens, groups), lambda known: F.array_compact(F.array(*[F.when(group_present(known, k, v), k) for k, v in groups.items()])))


def in_groups(tokens: Column, groups: dict[str, list[str]] = SYNONYMS) -> Column:
    """The distinct tokens that some group has a use for: all that its presence depends on, however long the text."""
    said = sorted({t for topic, phrases in groups.items() for p in [topic, *phrases] for t in plain_topic_tokens(p)})
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(*said)))


def group_present(tokens: Column, topic: str, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in [topic, *phrases]:
        hit = hit | all_in(plain_topic_tokens(p), tokens)
    return hit


def norm_text(text: Column) -> Column:
    """Lower case, everything but letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_joined(*normed: Column) -> Column:
    """norm_text of texts joined by blanks, from what norm_text makes of each: null and empty ones leave nothing."""
    return F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in normed])


def normalize_phrase(text: Column) -> Column:
    """Lower case, dashes to blanks, then letters and single blanks only."""
    dashes = F.regexp_replace(F.lower(text), "[-–—]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(dashes, r"(?U)[^a-z\s]", ""), r"(?U)\s+", " "))


def parse_amount(text: Column) -> Column:
    """A positive amount at the start of the text, without $ and commas, rounded; null otherwise."""
    number = F.regexp_extract(F.regexp_replace(text, "[$,]", ""), r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    return F.when(number > 0, js_round(number).cast("long"))


def parse_live_amount(text: Column) -> Column:
    """The digits and dots of the text as a number; null if there is none or it is 0."""
    return F.nullif(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def parse_date(text: Column) -> Column:
    """The accepted date forms as a UTC timestamp; null for anything else."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "MM/dd/yyyy")]
    return F.coalesce(*tries)


def dedupe_key(source: Column, record_id: Column) -> Column:
    return F.concat_ws("::", source, record_id)


def record_id_hash(key: Column) -> Column:
    """A 32-bit rolling hash of the key in base 36, with the key's first 32 characters made safe for an id."""

    def step(h: Column, c: Column) -> Column:
        wrapped = F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))
        return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)

    chars = F.filter(F.split(key, ""), lambda c: c != "")
    number = F.abs(F.aggregate(chars, F.lit(0).cast("long"), step)).cast("string")
    return F.concat(F.lit("idx_"), F.lower(F.conv(number, 10, 36)), F.lit("_"), F.regexp_replace(F.substring(key, 1, 32), "[^A-Za-z0-9]", "_"))


def ellipsis(text: Column, most: int = 400) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def first_language(names: Column) -> Column:
    """English, French or German text of a language-keyed map, or its first value."""
    return F.coalesce(names["eng"], names["fre"], names["deu"], F.try_element_at(F.map_values(names), F.lit(1)))
