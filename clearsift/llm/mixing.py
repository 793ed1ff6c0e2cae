"""Mixing sources to target weights by Efraimidis-Spirakis sampling in token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SYMBOLS, durable, with_prefix_sums, words

#: Uniform numbers come from this many leading hexadecimal digits of an MD5 digest.
_HEX_DIGITS = 13


def symbol_quality(text: Column, size: Column) -> Column:
    """A quality weight in [0.05, 1]: it falls with the number of markup symbols for each word."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """Budgets of sources (source, source_size): `share` of all words dealt by weight, none above `most_epochs` sizes.

    Weights are given to the sources in the order of their names (code points, null last), repeating. Dealing the
    excess anew until no source is above its cap equals one water level: sources are sorted by cap for each unit of
    weight; those whose cap lies below the level get the cap, the others their weight times the level.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    level = (F.col("budget") - F.col("caps_before")) / F.col("weight_left")
    return (
        sizes.withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") <= F.col("weight") * level)
        .withColumn("spare", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("spare") / F.col("open")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: int = 2,
    seed: str = "mix-1",
) -> DataFrame:
    """Takes words from every source near its target: whole epochs first, then a weighted sample without replacement.

    A source's complete epochs take each document once; the rest of its budget goes to documents in the order of
    -ln(u) / quality (Efraimidis and Spirakis), u a uniform number from the seed and the document's id, until the
    prefix sum of sizes reaches it: a document is taken if at least half of it fits. Returns doc_id, size (words),
    source_size, target, taken, source, quality and copies (how often it is taken); a document is taken at most `most_epochs` times.

    A null text has no words, and a document without words takes none. A null source is a source of its own.
    Documents with equal ids get equal keys and lie side by side in the order. An empty table gives an empty
    result. Further columns are ignored.
    """
    size = F.size(words(F.col("text"))).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**_HEX_DIGITS))
    keyed = docs.select("doc_id", "source", "text", size.alias("size")).select(
        "doc_id", "source", "size", symbol_quality(F.col("text"), F.col("size")).alias("quality"), uniform.alias("u")
    )
    keyed = durable(keyed.select("doc_id", "source", "size", "quality", (-F.log("u") / F.col("quality")).alias("key")), "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, most_epochs), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc_nulls_last(), F.col("size").asc()]
    placed = durable(with_prefix_sums(keyed, order, {"before": F.col("size")}, "mix-order"), "mix-placed")
    starts = placed.groupBy("source").agg(F.min("before").alias("start"))
    # One row for each source; whether it is broadcast is left to Spark's own check of its size.
    plan = durable(targets.alias("t").join(starts.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.start"), "mix-plan")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    half_fits = (F.col("epochs") < most_epochs) & (2 * (F.col("before") - F.col("start")) + F.col("size") <= 2 * rest)
    return (
        placed.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.doc_id", "d.source", "d.size", "d.quality", "d.before", "p.source_size", "p.target", "p.start")
        .withColumn("epochs", epochs)
        .withColumn("copies", F.col("epochs") + F.when(half_fits, F.lit(1)).otherwise(F.lit(0)))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "source",
            "quality",
            "copies",
        )
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every document as often as mix_sources takes it, with the columns it had.

    A document that is not taken is absent, one taken twice is there twice. Rows with equal id, source and size get
    the same number of copies, the largest of theirs.
    """
    size = F.size(words(F.col("text"))).cast("long")
    plan = mix_sources(docs, **params).groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    plan = durable(plan, "mix-copies").alias("p")
    # The row is one struct, so that no name of its columns can clash.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), size.alias("words"))
    same = F.col("id").eqNullSafe(F.col("p.doc_id")) & F.col("of").eqNullSafe(F.col("p.source")) & F.col("words").eqNullSafe(F.col("p.size"))
    return d.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("p.copies")))).select("row.*")
