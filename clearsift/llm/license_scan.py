"""License scans: templates with optional and replaceable regions become token automata that read documents word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .resampling import NOT_WORD

_NOT_WORD = re.compile(NOT_WORD)
_MARK = re.compile(r"\[\[|\]\]|\{\{\w+ \d+ \d+\}\}")


@dataclass(frozen=True)
class Template:
    """A license text. `[[ ]]` holds optional words (it may be nested); `{{name least most}}` stands for any words."""

    label: str
    text: str
    base: bool = False


# The three phrases of the contract.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Wording of public licenses and of their usual notices.
LICENSES = (
    Template("mit", "[[this {{work 1 4}} is]] released under the [[terms of the]] mit license"),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this {{work 1 3}} and associated
        documentation files [[the {{work 1 2}}]] to deal in the {{work 1 2}} without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the {{work 1 2}} and to permit persons to whom the
        {{work 1 2}} is furnished to do so subject to the following conditions [[the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the {{work 1 2}}]]"""),
    Template("isc", """permission to use copy modify and [[or]] distribute this software [[and its documentation]] for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("apache-2", "[[this {{work 1 4}} is]] licensed under the apache license version 2 [[0]] [[the license]]"),
    Template("apache-2", """licensed under the apache license version 2 [[0]] [[the license]] you may not use this {{work 1 3}} except in compliance
        with the license [[you may obtain a copy of the license at {{address 1 10}}]] unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied"""),
    Template("bsd", """redistribution and use [[of this software]] in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution
        [[ [[3]] neither the name of {{holder 1 12}} nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission]]"""),
    Template("gpl", "[[this {{work 1 4}} is]] licensed under the gnu [[lesser]] general public license [[version {{number 1 2}} [[or [[at your option]] any later version]]]]"),
    Template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version {{number 1 2}} of the license or at your option any later version"""),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "licensed under [[a]] cc by nc [[{{number 1 2}} [[international]]]]"),
    Template("cc-by-nc", "licensed under [[a]] creative commons attribution noncommercial [[{{number 1 2}} [[international]] license]]"),
    Template("cc-by", "licensed under [[a]] creative commons attribution {{number 2 2}} [[international]] license"),
    Template("cc-by-sa", "licensed under [[a]] creative commons attribution sharealike [[{{number 1 2}} [[international]] license]]"),
    Template("all-rights-reserved", "[[copyright [[c]] {{holder 1 8}}]] all rights reserved"),
)


@dataclass(frozen=True)
class Compiled:
    """A template's steps: `reads[i]` is the word that step i reads (None: any word), `follows[i]` the steps after it."""

    template: Template
    reads: tuple[str | None, ...]
    first: frozenset[int]
    follows: tuple[frozenset[int], ...]  # len(reads) stands for the end
    mandatory: tuple[tuple[str, ...], ...]  # runs of words that no text can leave out
    pattern: str  # the same language as an expression over words that each follow a blank

    @cached_property
    def n_mandatory(self) -> int:
        return sum(map(len, self.mandatory))


def _parse(template: Template) -> list:
    """The markup as a nested list: words, (least, most) for replaceable regions, lists for optional ones."""
    stack, at = [[]], 0
    for mark in [*_MARK.finditer(template.text), None]:
        gap = template.text[at : mark.start() if mark else None]
        stack[-1].extend(w for w in _NOT_WORD.split(gap.lower()) if w)
        if mark is None:
            break
        at = mark.end()
        if mark[0] == "[[":
            stack.append([])
        elif mark[0] == "]]":
            if len(stack) == 1:
                raise ValueError(f"{template.label}: a region ends that has not begun")
            region = stack.pop()
            stack[-1].append(region)
        else:
            least, most = map(int, mark[0].strip("{}").split()[1:])
            stack[-1].append((least, most))
    if len(stack) > 1:
        raise ValueError(f"{template.label}: a region does not end")
    return stack[0]


def compile_template(template: Template) -> Compiled:
    """Position automaton: each word or place for any word is one step; optional regions and counts decide what follows what."""
    reads: list[str | None] = []
    follows: list[set[int]] = []

    def link(ends: set[int], step: int) -> None:
        for e in ends:
            (first if e < 0 else follows[e]).add(step)

    def build(items: list, ends: set[int]) -> set[int]:
        for item in items:
            if isinstance(item, list):
                ends = ends | build(item, ends)
                continue
            least, most = (1, 1) if isinstance(item, str) else item
            open_ends = set(ends) if least == 0 else set()
            for k in range(most):
                reads.append(item if isinstance(item, str) else None)
                follows.append(set())
                link(ends, len(reads) - 1)
                ends = {len(reads) - 1}
                if k + 1 >= least:
                    open_ends |= ends
            ends = open_ends
        return ends

    def runs(items: list) -> Iterator[tuple[str, ...]]:
        run: list[str] = []
        for item in [*items, None]:
            if isinstance(item, str):
                run.append(item)
            elif run:
                yield tuple(run)
                run = []

    def pattern(items: list) -> str:
        parts = {str: lambda w: f" {w}", list: lambda o: f"(?:{pattern(o)})?", tuple: lambda c: "(?: [^ ]+){%d,%d}" % c}
        return "".join(parts[type(x)](x) for x in items)

    first: set[int] = set()
    items = _parse(template)
    link(build(items, {-1}), len(reads))
    if any(s == len(reads) or reads[s] is None for s in first):
        raise ValueError(f"{template.label}: the first word of a template has to be its own")
    return Compiled(template, tuple(reads), frozenset(first), tuple(map(frozenset, follows)), tuple(runs(items)), pattern(items))


@dataclass
class Automaton:
    """All templates as one automaton over words, made deterministic as texts are read."""

    templates: tuple[Compiled, ...]
    most_states: int = 50_000
    _moves: dict = field(default_factory=dict)

    @cached_property
    def words(self) -> frozenset[str]:
        return frozenset(w for t in self.templates for w in t.reads if w is not None)

    @cached_property
    def start(self) -> frozenset[tuple[int, int]]:
        return frozenset((k, s) for k, t in enumerate(self.templates) for s in t.first)

    @cached_property
    def first_words(self) -> frozenset[str]:
        return frozenset(self.templates[k].reads[s] for k, s in self.start)

    def move(self, state: frozenset, word: str | None) -> tuple[frozenset, tuple[int, ...]]:
        """The steps that may come after `word` (None: a word of no template), and the templates that end with it."""
        found = self._moves.get((state, word))
        if found is None:
            after = [(k, n) for k, s in state if self.templates[k].reads[s] in (None, word) for n in self.templates[k].follows[s]]
            ended = tuple(sorted({k for k, n in after if n == len(self.templates[k].reads)}))
            found = frozenset(x for x in after if x[1] < len(self.templates[x[0]].reads)), ended
            if len(self._moves) >= self.most_states:  # the table is only a cache
                self._moves.clear()
            self._moves[state, word] = found
        return found

    def places(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last) of every accepted place, the longest one for each template and start."""
        out = []
        for i, w in enumerate(words):
            if w not in self.first_words:
                continue
            state, longest, j = self.start, {}, i
            while state and j < len(words):
                state, ended = self.move(state, words[j] if words[j] in self.words else None)
                j += 1
                for k in ended:
                    longest[k] = j
            out.extend((k, i, end) for k, end in sorted(longest.items()))
        return out


def automaton(templates: tuple[Template, ...] = BASE + LICENSES) -> Automaton:
    return Automaton(tuple(map(compile_template, templates)))


def plain(text: Column) -> Column:
    """Lower-cased words with one blank between them."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


PLACE = "template int, label string, first_word long, end_word long"


def license_places(docs: DataFrame, templates: tuple[Template, ...] = BASE + LICENSES) -> DataFrame:
    """Adds `n_words` and `places` to the documents: every place that a template accepts, with its label and words from 0.

    A template is accepted where its mandatory words stand one after another and only its optional and replaceable regions differ. A text
    goes to the automaton only if it holds the longest mandatory run of some template, which nothing accepted can lack.
    `docs` needs a column text; columns named n_words or places are replaced.
    """
    machine = automaton(templates)
    anchors = sorted({" ".join(max(t.mandatory, key=len)) for t in machine.templates})
    anchors = [a for a in anchors if not any(b != a and b in a for b in anchors)]  # the part is enough

    @F.pandas_udf(f"array<struct<{PLACE.replace(' ', ':').replace(',:', ',')}>>")
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            if text is None:
                return []
            found = machine.places(text.split(" "))
            return [{"template": k, "label": machine.templates[k].template.label, "first_word": i, "end_word": end} for k, i, end in found]

        return texts.map(one, na_action=None)

    clean = docs.withColumn("_plain", plain(F.col("text")))
    possible = F.lit(False)
    for anchor in anchors:
        possible = possible | F.contains("_plain", F.lit(anchor))
    n_words = F.when(F.col("_plain") == "", 0).otherwise(F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit(""))) + 1)
    return clean.withColumn("n_words", n_words.cast("long")).withColumn("places", read(F.when(possible, F.col("_plain")))).drop("_plain")


def surety(n_mandatory: Column | float) -> Column:
    """How sure a match is, from 0 to 1: it grows with the mandatory words that were matched, four give 2/7."""
    return n_mandatory / (n_mandatory + F.lit(10.0))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + LICENSES) -> DataFrame:
    """Licenses of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word are of the places of base phrases (words from 0; null without one); base_labels are their
    labels, labels those of all templates, sorted and joined by commas (empty without one). The score is m / (m + 10), m the most
    mandatory words of an accepted template, 0 without one.

    A null text counts as empty; empty and wordless texts have no places. A text of any length is read whole. Several
    templates at one place all count; repeated rows and null ids are returned as they are; an empty table gives an
    empty result. Further columns, whatever their names, are ignored. One pass without a shuffle, so that no group of
    copies meets in one task.
    """
    machine = automaton(templates)
    is_base = F.array(*[F.lit(t.template.base) for t in machine.templates])
    weight = F.array(*[F.lit(float(t.n_mandatory)) for t in machine.templates])
    of = lambda c, p: F.element_at(c, p["template"] + 1)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    base = F.filter("places", lambda p: of(is_base, p))
    starts = F.transform(base, lambda p: p["first_word"])
    most = F.array_max(F.transform("places", lambda p: of(weight, p)))
    return license_places(docs.select("doc_id", "text"), templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(surety(most), F.lit(0.0)).alias("score"),
    )
