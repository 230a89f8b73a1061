"""All phrases of a list in one pass over a text.

The phrases of a list become one automaton (Aho and Corasick), which each Python worker builds once. It reads a text once, however many phrases there are, and finds them anywhere,
also inside longer words, and in the same pass those that must stand alone. Texts travel in Arrow batches; what comes back is the places of the phrases found in their list.
"""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strings


#: So many texts of a batch are Python strings at once.
SLICE = 64
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=64)
def machine(phrases: tuple[str, ...], alone: tuple[str, ...] = ()):  # noqa: ANN201
    """The automaton of both lists; each match tells all places that its phrase has in the first list, those that it has in the second, behind the first, and its length. None without phrases."""
    import ahocorasick

    places: dict[str, tuple[list[int], list[int]]] = {}
    for i, p in enumerate((*phrases, *alone)):
        places.setdefault(p, ([], []))[i >= len(phrases)].append(i)
    out = ahocorasick.Automaton()
    for p, (at, own) in places.items():
        if p:
            out.add_word(p, (tuple(at), tuple(own), len(p)))
    if not len(out):
        return None
    out.make_automaton()
    return out


def search(texts: pa.Array, phrases: tuple[str, ...], alone: tuple[str, ...] = ()) -> pa.Array:
    """For each text the places of the phrases it contains, ascending; none for a null. An empty phrase is in every text that isn't null."""
    find, always = machine(phrases, alone), [i for i, p in enumerate(phrases) if not p]
    out = []
    for start in range(0, len(texts), SLICE):
        for text in texts.slice(start, SLICE).to_pylist():
            if not find or not text:
                hits = ()
            elif alone:
                hits = set()
                for last, (at, own, n) in find.iter(text):
                    hits.add(at)
                    if own and own not in hits and not (last >= n and text[last - n] in _WORD) and text[last + 1 : last + 2] not in _WORD:
                        hits.add(own)
            else:
                hits = {at for _, (at, _, _) in find.iter(text)}
            out.append(sorted({i for at in hits for i in at}.union(always if text is not None else ())))
    return pa.array(out, pa.list_(pa.int32()))


def found(text: Column, phrases: tuple[str, ...] | list[str], alone: tuple[str, ...] | list[str] = ()) -> Column:
    """The places (from 0, ascending) in the list of the phrases that a text contains; none for a null text.

    Words of `alone` follow in the list. They count only where no ASCII letter, digit or _ touches them.
    """
    listed, words = tuple(phrases), tuple(alone)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        return search(texts, listed, words)

    return find(text.cast("string"))


def contained(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """The phrases that a text contains, in their order; one listed twice comes twice."""
    return let(found(text, phrases), lambda at: F.transform(at, lambda i: F.get(strings(tuple(phrases)), i)))


@lru_cache(maxsize=16)
def parts_machine(phrases: tuple[str, ...], heads: tuple[str, ...], tokens: tuple[str, ...]):  # noqa: ANN201
    """The automaton of three lists, whose matches tell a word's number, the words and their places in each list, by number. None without words."""
    import ahocorasick

    own: dict[str, tuple[list[int], list[int], list[int]]] = {}
    for i, p in enumerate((*phrases, *heads, *tokens)):
        own.setdefault(p, ([], [], []))[(i >= len(phrases)) + (i >= len(phrases) + len(heads))].append(i)
    own.pop("", None)
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, p in enumerate(own):
        out.add_word(p, n)
    if own:
        out.make_automaton()
    return out if own else None, list(own), list(own.values())


def _stands_alone(text: str, token: str) -> bool:
    at = text.find(token)
    while at >= 0:
        end = at + len(token)
        if not (at and text[at - 1] in _TOKEN) and text[end : end + 1] not in _TOKEN:
            return True
        at = text.find(token, at + 1)
    return False


def search_parts(texts: pa.Array, ends: pa.Array, phrases: tuple[str, ...], heads: tuple[str, ...], tokens: tuple[str, ...]) -> pa.Array:
    """As `search`: the phrases anywhere, those of `heads` only before each text's end, the tokens only where no a-z or 0-9 touches them.

    Words are gathered without a step of Python for each match; only tokens are looked at again.
    """
    (find, words, places), always = parts_machine(phrases, heads, tokens), [i for i, p in enumerate(phrases) if not p]
    longest, alone = max(map(len, words), default=0), {n for n, at in enumerate(places) if at[2]}
    out = []
    for start in range(0, len(texts), SLICE):
        for text, end in zip(texts.slice(start, SLICE).to_pylist(), ends.slice(start, SLICE).to_pylist(), strict=True):
            at = list(always) if text is not None else []
            if find and text:
                inside = set(map(itemgetter(1), find.iter(text, 0, end))) if end else set()
                beyond = set(map(itemgetter(1), find.iter(text, max(0, end - longest)))) - inside if end < len(text) else set()
                for n in inside:
                    at += places[n][0]
                    at += places[n][1]
                for n in beyond:
                    at += places[n][0]
                for n in alone & (inside | beyond):
                    if _stands_alone(text, words[n]):
                        at += places[n][2]
                at.sort()
            out.append(at)
    return pa.array(out, pa.list_(pa.int32()))


def found_parts(text: Column, end: Column, phrases: tuple[str, ...] | list[str], heads: tuple[str, ...] | list[str], tokens: tuple[str, ...] | list[str] = ()) -> Column:
    """`found` for three lists in a row, in one pass: phrases anywhere in the text, `heads` only within its first `end` characters, and `tokens`, runs of a-z and 0-9, where they are whole tokens of `raw_tokens`.

    The text is lower-cased by the caller.
    """
    listed, inside, words = tuple(phrases), tuple(heads), tuple(tokens)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array, ends: pa.Array) -> pa.Array:
        return search_parts(texts, ends, listed, inside, words)

    return find(text.cast("string"), end.cast("int"))
