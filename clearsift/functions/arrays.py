"""Functions on arrays of words, quotes and spans, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a title or a sentence: connectives, and common words.
STOP_WORDS = (
    "agar yang dan atau di ke untuk dengan karena bahwa dari pada serta sebagai dalam oleh akan jika kalau tetapi namun sehingga "
    "ini itu adalah juga telah sudah para sebuah tidak bukan lebih semua setiap setelah sebelum ketika saat hanya masih banyak harus dapat"
).split()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once a row: an expression that a loop over an array reads is computed in each
    of its turns, also where it is a column that Spark puts in its place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_words(x: Column) -> Column:
    """All words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def says_something(w: Column, stop_words: list[str] | None = None) -> Column:
    """Whether a word has four letters or more, or three characters with a digit, and is no stop word."""
    heavy = (F.length(w) >= 4) | ((F.length(w) == 3) & (F.translate(w, "0123456789", "") != w))
    return heavy & ~w.isin(STOP_WORDS if stop_words is None else stop_words)


def content_words(x: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct words that say something."""
    return F.array_distinct(F.filter(plain_words(x), lambda w: says_something(w, stop_words)))


def word_in(word: Column, words: Column) -> Column:
    """Whether a word is among others: equal, or from five letters on one part of the other."""
    part = lambda w: (w == word) | ((F.length(word) >= 5) & (F.length(w) >= 5) & (F.contains(w, word) | F.contains(word, w)))
    return F.exists(words, part)


def word_in_misread(word: Column, words: Column) -> Column:
    """Like word_in, and tolerant of misread letters: one edit from five letters on, two from seven; digits must agree."""
    most = F.when(F.length(word) >= 7, F.lit(2)).when(F.length(word) >= 5, F.lit(1)).otherwise(F.lit(0))

    def near(w: Column) -> Column:
        close = (F.abs(F.length(w) - F.length(word)) <= most) & F.levenshtein(w, word, 2).between(0, most)
        return (F.length(w) >= 5) & close & ~w.rlike("[0-9]")

    readable = (F.length(word) >= 5) & ~word.rlike("[0-9]")
    return F.array_contains(words, word) | word_in(word, words) | (readable & F.exists(words, near))


def words_found(wanted: Column, words: Column, misread: bool = False) -> Column:
    """How many of the wanted words are among the others."""
    test = word_in_misread if misread else word_in
    return F.size(F.filter(wanted, lambda w: test(w, words)))


def weighted_share(wanted: Column, words: Column, weights: Column, default: Column) -> Column:
    """Weight of the wanted words that are found, in the weight of all; 1 without wanted words."""
    weight = lambda w: F.coalesce(F.element_at(weights, w), default)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + weight(w))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(total(F.filter(wanted, lambda w: word_in(w, words))) / total(wanted))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def quotes_found(quotes: Column, text: Column) -> Column:
    """How many quotes occur in a text, white space and case aside."""
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.size(F.filter(quotes, lambda q: (norm(q) != "") & F.contains(norm(text), norm(q))))


def share_found(words: Column, text: Column) -> Column:
    """Share of words that occur in a text as substrings; 1 without words."""
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) / F.size(words))


def contain_each_other(a: Column, b: Column) -> Column:
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.contains(norm(a), norm(b)) | F.contains(norm(b), norm(a))


def merge_evidence(first: Column, second: Column, most: int = 3) -> Column:
    """Evidence of two sources: what both have first, then the first's, then the second's; none twice, at most `most`."""
    both = F.filter(first, lambda a: F.exists(second, lambda b: contain_each_other(a, b)))
    rest = F.filter(second, lambda b: ~F.exists(first, lambda a: contain_each_other(a, b)))
    return F.slice(F.array_distinct(F.concat(both, first, rest)), 1, most)


def best_window(words: Column, reference: Column, width: int) -> Column:
    """The run of `width` words with the most reference words; the earliest of equals. All words if there are fewer."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    scored = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.size(F.array_intersect(F.transform(F.slice(words, i + 1, width), lambda w: F.lower(w)), reference)).alias("n"), (-i).alias("before")),
    )
    return F.slice(words, 1 - F.array_max(scored)["before"], width)


def dedup_ordered(words: Column) -> Column:
    """Each element once, where it first stands."""
    return F.array_distinct(words)


def closest_passage(sentence: Column, title: Column, narrative: Column, most: int) -> Column:
    """struct(passage, in_title, in_all, share): the run of words of at most `most` characters that is closest to an article.

    Runs are ranked by the title's words they hold, then by all of the article's, then by their share among their own
    content words; the earliest of equals wins. Words at the ends that the article does not hold are cut off, but for
    short ones beside one that it holds. `title` and `narrative` are content words.
    """
    read = F.filter(F.split(F.coalesce(sentence, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    given = F.struct(read.alias("words"), title.alias("title"), F.array_union(title, narrative).alias("every"))
    ends_of = lambda words: F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w) + 1)))
    return once(given, lambda g: once(ends_of(g["words"]), lambda ends: _closest(g["words"], ends, g["title"], g["every"], most)))


def _closest(words: Column, ends: Column, title: Column, every: Column, most: int) -> Column:
    """closest_passage of words, of which each ends a blank before its place in `ends`. All of these are bound: loops read them."""
    # Of each start the number of words that fit; one that is longer than all stands alone. No more than half as many words as characters fit.
    fit = lambda i, at: F.size(F.filter(F.slice(ends, i + 2, (most + 1) // 2), lambda e: e - 1 - at <= most))
    size = lambda i: F.greatest(F.lit(1), once(F.get(ends, i), lambda at: fit(i, at)))
    whole = F.element_at(ends, -1) - 1 <= most
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))))

    def scored(i: Column) -> Column:
        n = F.when(whole, F.size(words)).otherwise(size(i))
        own = content_words(F.array_join(F.slice(words, i + 1, n), " "))
        held = F.size(F.array_intersect(own, every))
        return F.struct(F.size(F.array_intersect(own, title)).alias("in_title"), held.alias("in_all"), F.when(F.size(own) > 0, held / F.size(own)).otherwise(0.0).alias("share"), (-i).alias("before"), n.alias("n"))

    best = F.array_max(F.transform(starts, scored))

    def trimmed(b: Column) -> Column:
        known = F.when(b["in_title"] >= 3, title).otherwise(every)
        bare = lambda i: F.lower(F.regexp_replace(F.coalesce(F.get(words, i), F.lit("")), r"(?U)^\W+|\W+$", ""))
        held = lambda i: F.array_contains(known, bare(i))
        ok = lambda i, beside: held(i) | ((F.length(bare(i)) <= 3) & held(beside))
        first, last = -b["before"], -b["before"] + b["n"] - 1
        places = F.sequence(first, last)
        left = F.coalesce(F.array_min(F.filter(places, lambda i: ok(i, i + 1))), last)
        right = F.greatest(left, F.coalesce(F.array_max(F.filter(places, lambda i: ok(i, i - 1))), left))
        return F.array_join(F.slice(words, left + 1, right - left + 1), " ")

    found = F.get(F.transform(F.array(best), lambda b: F.struct(trimmed(b).alias("passage"), b["in_title"].alias("in_title"), b["in_all"].alias("in_all"), b["share"].alias("share"))), 0)
    return F.when(F.size(words) > 0, found)


def files_to_delete(old: Column, new: Column) -> Column:
    """Names of an old list that a new one does not have."""
    return F.array_sort(F.array_except(old, new))


def wrap_words(words: Column, width: int) -> Column:
    """Lines of at most `width` characters, filled greedily; a longer word is a line of its own."""
    start = F.array().cast("array<string>")

    def add(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        longer = F.concat_ws(" ", last, w)
        fits = (F.size(lines) > 0) & (F.length(longer) <= width)
        return F.when(fits, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words, start, add)


def class_runs(x: Column, inside: str) -> Column:
    """A text cut into the longest runs inside and outside a class of characters."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"[{inside}]+|[^{inside}]+"), F.lit(0))
