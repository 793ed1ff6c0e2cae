"""Phrases of words found in one pass over the tokens of a text: word lists, gaps between them, what may not follow."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F

FOUND = "array<struct<rule:string,strength:string,s:int,e:int>>"
_LOWER = {c: c + 32 for c in range(65, 91)}


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _digits() -> str:
    """What a pattern's class of str.isdigit holds: decimal digits, and superscripts and the like."""
    return r"\d" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())


@dataclass(frozen=True)
class Words:
    """One of some words. `_` stands between the words of a phrase, a closing * for any ending. `colon`: one may follow,
    with or without a blank. `unless`: phrases that may not follow."""

    choices: tuple[str, ...]
    colon: bool = False
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number:
    """A number of at most `digits` digits, with one of some units behind it, if there are any, with or without a blank."""

    digits: int = 1 << 30
    units: tuple[str, ...] = ()


@dataclass(frozen=True)
class Gap:
    """Up to `most` tokens, of these words only if there are any."""

    most: int
    words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Phrase:
    rule: str
    strength: str
    parts: tuple[Words | Number | Gap, ...]


def phrase(rule: str, strength: str, *parts: list[str] | str | Words | Number | Gap | int) -> Phrase:
    """A phrase of word lists (or words divided by blanks); a number is a gap of up to so many tokens."""
    kind = {str: lambda p: Words(tuple(p.split())), list: lambda p: Words(tuple(p)), int: Gap}
    return Phrase(rule, strength, tuple(kind[type(p)](p) if type(p) in kind else p for p in parts))


class Matcher:
    """Finds phrases: for each rule and strength the leftmost ones, the first in the list where several begin, without overlap.

    One pattern of the first words of all phrases finds the places where one may begin; a text that holds none is not cut into
    tokens. Words end where their letters and digits end; only whole tokens stand between the first word of a phrase and its last one.
    """

    def __init__(self, phrases: list[Phrase]):
        self.phrases = phrases
        self.exact: dict[str, list[int]] = {}
        self.begins: dict[int, dict[str, list[int]]] = {}
        self.numbers = [i for i, p in enumerate(phrases) if isinstance(p.parts[0], Number)]
        for i, p in enumerate(phrases):
            for w in {c.split("_")[0] for c in p.parts[0].choices} if isinstance(p.parts[0], Words) else ():
                if w.endswith("*"):
                    self.begins.setdefault(len(w) - 1, {}).setdefault(w[:-1], []).append(i)
                else:
                    self.exact.setdefault(w, []).append(i)
        self.first = re.compile(rf"\b(?=\w)(?:{self._first_words()})")

    def _first_words(self) -> str:
        """A pattern of the first words of all phrases, by their first letters; a number begins with any digit."""
        by_letter: dict[str, list[str]] = {}
        for w in self.exact:
            by_letter.setdefault(w[0], []).append(re.escape(w[1:]) + r"(?!\w)")
        for w in (w for words in self.begins.values() for w in words):
            by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
        either = [f"{re.escape(c)}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items())]
        return "|".join(either + ([f"[{_digits()}]"] if self.numbers else []))

    def _starting(self, token: str, at: int) -> list[int]:
        """The phrases whose first word may stand at a place of a token, in their order."""
        end = at
        while end < len(token) and is_word(token[end]):
            end += 1
        found: list[int] = []
        for stop in {end, *(i for i in range(end + 1, len(token) + 1) if i == len(token) or not is_word(token[i]))}:  # words with a hyphen, a dot or an apostrophe
            found += self.exact.get(token[at:stop], ())
        for n, words in self.begins.items():
            found += words.get(token[at : at + n], ())
        if self.numbers and token[at].isdigit():
            found += self.numbers
        return sorted(set(found))

    def find(self, text: str) -> list[tuple[str, str, int, int]]:
        text = text.translate(_LOWER)
        places = [m.start() for m in self.first.finditer(text)]
        if not places:
            return []
        tokens = text.split(" ")
        starts = list(accumulate((len(t) + 1 for t in tokens[:-1]), initial=0))
        out, free = [], {}
        for at in places:
            i = bisect_right(starts, at) - 1
            o = at - starts[i]
            for k in self._starting(tokens[i], o):
                p = self.phrases[k]
                group = (p.rule, p.strength)
                if at < free.get(group, 0):
                    continue
                end = next(_ends(tokens, i, o, p.parts), None)
                if end is not None:
                    free[group] = starts[end[0]] + end[1]
                    out.append((*group, at, free[group]))
        return out


def _ends(tokens: list[str], i: int, o: int, parts: tuple) -> Iterator[tuple[int, int]]:
    """(token, place in it) behind each way in which parts match from a place, the shortest gaps first."""
    part, rest = parts[0], parts[1:]
    if isinstance(part, Gap):
        for n in range(part.most + 1):
            yield from _ends(tokens, i + n, 0, rest)
            if i + n >= len(tokens) or (part.words and tokens[i + n] not in part.words):
                return
        return
    for j, end in _word_ends(tokens, i, o, part):
        if not rest:
            yield j, end
        elif end == len(tokens[j]):
            yield from _ends(tokens, j + 1, 0, rest)


def _word_ends(tokens: list[str], i: int, o: int, part: Words | Number) -> Iterator[tuple[int, int]]:
    if i >= len(tokens):
        return
    if isinstance(part, Number):
        end = o
        while end < len(tokens[i]) and tokens[i][end].isdigit():
            end += 1
        if not 0 < end - o <= part.digits:
            return
        if not part.units:
            yield i, end
        elif end < len(tokens[i]):
            yield from _word_ends(tokens, i, end, Words(part.units))
        else:
            yield from _word_ends(tokens, i + 1, 0, Words(part.units))
        return
    for choice in part.choices:
        j, at, words = i, o, choice.split("_")
        for k, w in enumerate(words):
            if j >= len(tokens) or not tokens[j].startswith(w.rstrip("*"), at):
                break
            at += len(w.rstrip("*"))
            if w.endswith("*"):
                while at < len(tokens[j]) and is_word(tokens[j][at]):
                    at += 1
            elif at < len(tokens[j]) and is_word(tokens[j][at]):
                break
            if k + 1 < len(words):
                if at < len(tokens[j]):
                    break
                j, at = j + 1, 0
        else:
            if not any(_follows(tokens, j, at, u) for u in part.unless):
                if part.colon and at + 1 == len(tokens[j]) and tokens[j][at] == ":":
                    yield j, at + 1
                elif part.colon and at == len(tokens[j]) and j + 1 < len(tokens) and tokens[j + 1] == ":":
                    yield j + 1, 1
                yield j, at


def _follows(tokens: list[str], j: int, at: int, words: str) -> bool:
    return at == len(tokens[j]) and any(True for _ in _word_ends(tokens, j + 1, 0, Words((words,))))


def phrase_spans(phrases: list[Phrase]):
    """A function over a column of one-line texts: the places of all phrases, in characters."""
    matcher = Matcher(phrases)

    @F.pandas_udf(FOUND)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"rule": r, "strength": g, "s": s, "e": e} for r, g, s, e in matcher.find(t or "")], na_action=None)

    return spans
