"""Alignment of characters and places: error rates of a reading, highlights of evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_COUNTS = T.StructType([T.StructField("errors", T.LongType()), T.StructField("characters", T.LongType())])
_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def _best_row(a: str, b: str, free: set[int], first: np.ndarray) -> np.ndarray:
    """The last row of edit distances of b against a; places of a in `free` cost nothing to miss or replace."""
    row = first.copy()
    codes = np.fromiter(map(ord, a), np.int64, len(a))
    miss = np.ones(len(a), np.int64)
    miss[list(free)] = 0
    drops = np.concatenate([[0], np.cumsum(miss)])
    for j, c in enumerate(map(ord, b), 1):
        step = np.empty_like(row)
        step[0] = row[0] + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + np.where(codes == c, 0, miss))
        # Misses run along the row: the least of earlier values, less what is dropped up to there, plus what is now.
        row = np.minimum.accumulate(step - drops) + drops
        del j
    return row


def character_errors(reference: str, reading: str, wildcard: str = "\x00", interface: str = "\x01") -> tuple[int, int]:
    """(errors, characters): edits of a reading against a transcript. Characters after a wildcard mark count as free
    matches; what stands between two interface marks may be read or not, at no cost."""
    chars, free, n, ui = [], set(), 0, False
    for c in reference or "":
        if c == interface:
            ui = not ui
        elif c == wildcard:
            free.add(len(chars))
            chars.append(c)
        else:
            if ui:
                free.add(len(chars))
            else:
                n += 1
            chars.append(c)
    text = "".join(chars)
    if not free:
        return edit_distance(text, reading or ""), n
    miss = np.ones(len(text), np.int64)
    miss[list(free)] = 0
    last = _best_row(text, reading or "", free, np.concatenate([[0], np.cumsum(miss)]))
    return int(last[-1]), n


def _places(pattern: str) -> dict[str, int]:
    """Of each character the bits of the places where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit by bit (Myers, Hyyrö): the differences between neighbouring rows are the bits of two integers of
    a text's length, so that a character of the other costs a dozen operations on whole words."""
    if not a or not b:
        return len(a) or len(b)
    full, of = (1 << len(a)) - 1, _places(a).get
    up, down = full, 0
    for c in b:
        same = of(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = ((down | (full & ~(diagonal | up))) << 1) | 1
        up, down = (((up & diagonal) << 1) | ~(diagonal | right)) & full, right & diagonal & full
    return len(b) + up.bit_count() - down.bit_count()


def substring_distance(needle: str, haystack: str) -> int:
    """The least number of edits that make a piece of the haystack equal to the needle (Sellers' recurrence, bit by bit: a piece
    may begin at any character, at no cost)."""
    if not needle or needle in (haystack or ""):
        return 0
    full, last, of = (1 << len(needle)) - 1, 1 << (len(needle) - 1), _places(needle).get
    up, down, score = full, 0, len(needle)
    best = score
    for c in haystack or "":
        same = of(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if left & last:
            score -= 1
            if score < best:
                best = score
        elif right & last:
            score += 1
        right <<= 1
        up, down = ((left << 1) | ~(diagonal | right)) & full, right & diagonal & full
    return best


@pandas_udf(_COUNTS)
def character_error_counts(reference: pd.Series, reading: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([character_errors(a, b) for a, b in zip(reference, reading, strict=True)], columns=["errors", "characters"])


@pandas_udf(T.LongType())
def nearest_piece_distance(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    return pd.Series([substring_distance(a or "", b or "") for a, b in zip(needle, haystack, strict=True)], dtype="int64")


def character_error_rate(reference: Column, reading: Column) -> Column:
    """Errors for each character of the content; 0 for an empty transcript."""
    counts = character_error_counts(reference, reading)
    return F.when(counts["characters"] > 0, counts["errors"] / counts["characters"]).otherwise(F.lit(0.0))


def word_retention(reference: Column, cleaned: Column) -> Column:
    """struct(kept, lost): content words of a transcript that cleaning kept and lost."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    return F.struct(F.size(F.array_intersect(words(reference), words(cleaned))).alias("kept"), F.size(F.array_except(words(reference), words(cleaned))).alias("lost"))


@pandas_udf(_SPANS)
def highlight_spans(text: pd.Series, evidence: pd.Series) -> pd.Series:
    """Places of all occurrences of evidence in a text, white space aside, overlapping ones included, merged."""

    def one(t: str | None, quotes) -> list[dict]:
        at = [i for i, c in enumerate(t or "") if not c.isspace()]
        bare = "".join(t[i] for i in at) if t else ""
        found = []
        for q in quotes if quotes is not None else ():
            wanted = "".join((q or "").split())
            k = bare.find(wanted) if wanted else -1
            while k >= 0:
                found.append((at[k], at[k + len(wanted) - 1] + 1))
                k = bare.find(wanted, k + 1)
        out: list[list[int]] = []
        for s, e in sorted(found):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [{"s": s, "e": e} for s, e in out]

    return pd.Series([one(t, q) for t, q in zip(text, evidence, strict=True)])
