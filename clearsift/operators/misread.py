"""Words that differ in misread letters, found by what is left of them when letters are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_edits(word: Column) -> Column:
    """Edits that a misread word may have: one from five letters on, two from seven; none with digits."""
    n = F.length(word)
    return F.when(F.translate(word, "0123456789", "") != word, 0).when(n >= 7, 2).when(n >= 5, 1).otherwise(0)


def _shorter(word: Column) -> Column:
    """A word without each of its letters."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _left_over(word: Column, deletions: int) -> Column:
    """Hashes of all that is left of a word when up to so many letters go."""
    level = F.array(word)
    every = level
    for _ in range(deletions):
        level = F.array_distinct(F.flatten(F.transform(level, _shorter)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda w: F.xxhash64(w)))


def misread_pairs(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """(token, near): the words of `read` (token) from five letters on that a wanted word (token) may have become.

    Two words within k edits share what is left of both after at most k deletions each. So distinct words meet in a join of hashes,
    a word of n letters with n * n / 2 of them at most, and only what meets is measured: no word is held against all others.
    """
    distinct = lambda df: df.select("token").distinct().filter((F.length("token") >= 5) & (F.translate("token", "0123456789", "") == F.col("token")))
    left, right = distinct(wanted), distinct(read)
    one, two = F.length("token") < 7, F.length("token") >= 7
    keyed = lambda df, name: df.filter(one).select(F.col("token").alias(name), F.explode(_left_over(F.col("token"), 1)).alias("h"))
    twice = lambda df, name: df.select(F.col("token").alias(name), F.explode(_left_over(F.col("token"), 2)).alias("h"))
    near_words = keyed(left, "token").join(right.filter(F.length("token") <= 7).select(F.col("token").alias("near"), F.explode(_left_over(F.col("token"), 1)).alias("h")), "h")
    far_words = twice(left.filter(two), "token").join(twice(right, "near"), "h")
    met = near_words.unionByName(far_words).select("token", "near").distinct()
    return met.filter((F.abs(F.length("token") - F.length("near")) <= most_edits(F.col("token"))) & (F.levenshtein("token", "near") <= most_edits(F.col("token"))))


def words_found_misread(pairs: DataFrame, titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, n_found): how many distinct words of a pair's title are in its text, equal or misread.

    pairs (pair_id, title_id, text_id), titles (title_id, token), texts (text_id, token). A title's words are held against those of
    its pair's text alone: where a vocabulary is dense, far more words are near each other in it than in any pair.
    """
    asked = pairs.join(titles.distinct(), "title_id").select("pair_id", "text_id", "token")
    near = texts.distinct().select(F.col("text_id").alias("_text"), F.col("token").alias("near"))
    edits = most_edits(F.col("token"))
    misread = (F.length("near") >= 5) & (most_edits(F.col("near")) > 0) & (edits > 0) & (F.abs(F.length("token") - F.length("near")) <= edits) & (F.levenshtein("token", "near") <= edits)
    found = asked.join(near, (F.col("text_id") == F.col("_text")) & ((F.col("token") == F.col("near")) | misread), "left_semi")
    counted = found.select("pair_id", "token").distinct().groupBy("pair_id").agg(F.count("*").alias("n_found"))
    return pairs.select("pair_id").join(counted, "pair_id", "left").na.fill(0, ["n_found"])
