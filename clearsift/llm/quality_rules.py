"""Quality rules with thresholds that adapt to language and source, from mergeable quantile sketches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SYMBOLS, durable, words

_HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Fence:
    """A bound `reach` spreads beyond the quartiles of a metric; the spread is the quartiles' distance, at least `least`."""

    metric: str
    reach: int
    least: int
    two_sided: bool = False


#: mean_len: hundredths of a character a word; symbols: a thousand characters; dup_lines and repeats: a thousand words.
FENCES = (Fence("mean_len", 4, 20, two_sided=True), Fence("symbols", 3, 10), Fence("dup_lines", 3, 15), Fence("repeats", 3, 20))
#: So many repeated words count for nothing: one line that stands twice in a short clean text.
REPEATS_FREE = 40


def window_hashes(hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` elements of an array of hashes; none if it is shorter."""
    last = F.size(hashes) - width
    run = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def text_features(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_HAS_WORD))
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("text")).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    runs = hashed.select(*keep, window_hashes(F.col("h"), window).alias("runs"))
    # Only texts that repeat a window at all go on: sort (hash, place), find equal neighbours, add up what they cover.
    placed = F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("runs")) < F.size("runs")
    sorted_ = runs.select(*keep, F.when(some, placed).alias("placed"))
    again = F.filter(
        "placed",
        lambda x, i: F.coalesce(F.get("placed", i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get("placed", i + 1).h == x.h, F.lit(False)),
    )
    at = sorted_.select(*keep, F.sort_array(F.transform(again, lambda x: x.i)).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("at", i + 1), p + window) - p)),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return at.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def metric_values(features: DataFrame) -> DataFrame:
    """Whole numbers for the sketches; mean_len is null under 100 words, where a mean says little."""
    return features.withColumns(
        {
            "mean_len": F.expr("CASE WHEN n_words >= 100 THEN (100 * word_chars) div n_words END"),
            "symbols": F.expr("CASE WHEN n_words > 0 THEN (1000 * n_symbols) div word_chars END"),
            "dup_lines": F.expr("CASE WHEN n_words > 0 THEN (1000 * n_dup_lines) div n_words END"),
            "repeats": F.expr(f"CASE WHEN n_words > 0 THEN (1000 * greatest(n_repeat_words - {REPEATS_FREE}, 0)) div n_words END"),
        }
    )


#: Buckets of the sketch: values under 128 exactly, others by their seven leading bits (an error under 1/64).
_BUCKET = "CASE WHEN v < 128 THEN v ELSE shiftright(v, length(bin(v)) - 7) + 64L * (length(bin(v)) - 7) END"
_FLOOR = "CASE WHEN {0} < 128 THEN {0} ELSE shiftleft({0} - 64 * ({0} div 64 - 1), CAST({0} div 64 - 1 AS INT)) END"


def sketch(values: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Quantile sketches (lang, source, metric, b, n): counts of buckets, which merge by adding up."""
    pairs = F.array(*[F.struct(F.lit(f.metric).alias("metric"), F.col(f.metric).cast("long").alias("v")) for f in fences])
    return (
        values.select("lang", "source", F.inline(pairs))
        .filter("v IS NOT NULL")
        .groupBy("lang", "source", "metric", F.expr(_BUCKET).alias("b"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merges sketches to the groups of `by` and reads n, q1 and q3 of every metric."""
    merged = sketches.groupBy(*by, "metric", "b").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*by, "metric").orderBy("b")
    ranked = merged.withColumn("seen", F.sum("n").over(up_to)).withColumn("of", F.sum("n").over(Window.partitionBy(*by, "metric")))
    return ranked.groupBy(*by, "metric").agg(
        F.max("of").alias("n"),
        F.min(F.when(4 * F.col("seen") >= F.col("of"), F.col("b"))).alias("b1"),
        F.min(F.when(4 * F.col("seen") >= 3 * F.col("of"), F.col("b"))).alias("b3"),
    ).withColumns({"q1": F.expr(_FLOOR.format("b1")), "q3": F.expr(_FLOOR.format("b3"))}).drop("b1", "b3")


def thresholds(sketches: DataFrame, least_rows: int, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """One row for each (lang, source): lo_ and hi_ of every metric.

    A group with fewer than `least_rows` values uses its language's merged sketch, and that the one of all rows.
    """
    own, lang, all_ = (quartiles(sketches, by).alias(name) for by, name in ((["lang", "source"], "o"), (["lang"], "l"), ([], "a")))
    names = F.explode(F.array(*[F.lit(f.metric) for f in fences])).alias("metric")
    grid = sketches.select("lang", "source").distinct().select("lang", "source", names).alias("g")
    metric = F.col("g.metric")
    joined = (
        grid.join(own, F.col("o.lang").eqNullSafe(F.col("g.lang")) & F.col("o.source").eqNullSafe(F.col("g.source")) & (F.col("o.metric") == metric), "left")
        .join(lang, F.col("l.lang").eqNullSafe(F.col("g.lang")) & (F.col("l.metric") == metric), "left")
        .join(all_, F.col("a.metric") == metric, "left")
    )
    pick = lambda c: F.when(F.col("o.n") >= least_rows, F.col(f"o.{c}")).when(F.col("l.n") >= least_rows, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    flat = joined.select("g.lang", "g.source", metric.alias("metric"), pick("q1").alias("q1"), pick("q3").alias("q3"))
    bounds = []
    for f in fences:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(f.least))
        mine = F.col("metric") == f.metric
        bounds.append(F.max(F.when(mine, F.col("q3") + f.reach * spread)).alias(f"hi_{f.metric}"))
        if f.two_sided:
            bounds.append(F.max(F.when(mine, F.col("q1") - f.reach * spread)).alias(f"lo_{f.metric}"))
    return flat.groupBy("lang", "source").agg(*bounds)


def quality_rules(docs: DataFrame, least_rows: int = 50, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Judges every document by its own language's and source's usual values.

    Fixed rules come first (base_failed: fewer than 20 words, or over 30% of words in repeated 8-word windows). The
    rest give the quantile sketches; a document is kept if every metric lies inside its group's fences, which are
    joined back to the documents. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept.

    Fences are inclusive (ties stay); a very long text is judged by its rates as any other.
    A null or blank text has no words and fails. Null languages and sources are groups of their own. A metric that
    a document or a group has no value for rejects nothing. Repeated rows are judged one by one; an empty table
    gives an empty result; further columns are ignored.
    """
    features = text_features(docs)
    features = durable(features.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "rules-features")
    values = metric_values(features)
    sketches = durable(sketch(values.filter(~F.col("base_failed")), fences), "rules-sketch")
    bounds = durable(thresholds(sketches, least_rows, fences), "rules-bounds")
    inside = F.lit(True)
    for f in fences:
        inside &= F.coalesce(F.col(f.metric) <= F.col(f"hi_{f.metric}"), F.lit(True))
        if f.two_sided:
            inside &= F.coalesce(F.col(f.metric) >= F.col(f"lo_{f.metric}"), F.lit(True))
    return (
        values.alias("d")
        .join(bounds.alias("b"), F.col("d.lang").eqNullSafe(F.col("b.lang")) & F.col("d.source").eqNullSafe(F.col("b.source")), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
    )
