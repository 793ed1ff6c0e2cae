"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, words
from .quality_rules import window_hashes


def shingle_sets(rows: DataFrame, width: int, out: str) -> DataFrame:
    """Replaces `text` by `out`: distinct hashes of the runs of `width` lower-cased words; of fewer words, the whole
    sequence is the only one. The steps are columns of their own, so that a lambda never computes one anew."""
    keep = [c for c in rows.columns if c != "text"]
    hashed = rows.select(*keep, F.transform(words(F.lower("text")), lambda w: F.xxhash64(w)).alias("h"))
    runs = F.when(F.size("h") >= width, window_hashes(F.col("h"), width)).when(F.size("h") > 0, F.array(F.xxhash64("h")))
    return hashed.select(*keep, F.array_distinct(F.coalesce(runs, F.array().cast("array<bigint>"))).alias(out))


def item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """Adds each item's bottom-k MinHash sketch; k depends on the item's size class (a power of two).

    If `percent` of an item's n shingles lie in a document, at most n - ceil(percent * n / 100) do not, so that any
    one more of them than that must hit it. k is this number for the largest size of the class: a search by sketch
    loses nothing.
    """
    n = F.size("item_set")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    k = F.least(n, F.floor(largest * F.lit((100 - percent) / 100) + 1e-9).cast("int") + 1)
    return items.withColumns({"n_item_shingles": n, "sketch": F.slice(F.sort_array("item_set"), F.lit(1), k)})


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id) where at least `percent` of the item's distinct word shingles occur in the document.

    Returns doc_id, item_id, n_item_shingles, n_shared and containment. A null or blank item or document has no
    shingles and is in no pair; one with fewer than `width` words has a single shingle, its whole sequence, and so
    is found only in a document with the same words. Very long texts are searched whole. Rows of equal ids are searched one by one, and their best
    containment is returned. Null ids are left out. Empty tables give an empty result; further columns are ignored.
    """
    bench = shingle_sets(items.filter("item_id IS NOT NULL").select("item_id", "text"), width, "item_set")
    bench = durable(bench.select("item_id", F.sort_array("item_set").alias("item_set")).distinct(), "bench-sets")
    bench = durable(item_sketches(bench.filter(F.size("item_set") > 0), percent), "bench")
    probes = durable(bench.select(F.explode("sketch").alias("h"), "item_id").distinct(), "bench-sketch")
    whole = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    # The sketches are written, so that Spark knows their size and broadcasts them only under its own threshold.
    # explode_outer: a filter on explode's input would be pushed below the sets and compute them once more for each row
    searched = shingle_sets(whole, width, "doc_set").select("doc_id", F.explode_outer("doc_set").alias("h"))
    hits = searched.join(probes, "h").select("doc_id", "item_id").distinct()
    hits = durable(hits, "bench-hits")
    suspects = whole.join(durable(hits.select("doc_id").distinct(), "bench-suspects"), "doc_id", "left_semi")
    pairs = shingle_sets(suspects, width, "doc_set").join(hits, "doc_id").join(bench.select("item_id", "n_item_shingles", "item_set"), "item_id")
    counted = pairs.select("doc_id", "item_id", "n_item_shingles", F.size(F.array_intersect("doc_set", "item_set")).alias("n_shared"))
    return (
        counted.filter(100 * F.col("n_shared") >= percent * F.col("n_item_shingles"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_item_shingles", "n_shared", "containment"), F.struct("containment", "n_shared")).alias("best"))
        .select("doc_id", "item_id", F.col("best.n_item_shingles").cast("long").alias("n_item_shingles"), F.col("best.n_shared").cast("long").alias("n_shared"), "best.containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no benchmark item; rows without an id are kept, as they cannot be named as leaks."""
    leaks = durable(find_contamination(docs, items, width, percent).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"] == leaks["doc_id"], "left_anti")
