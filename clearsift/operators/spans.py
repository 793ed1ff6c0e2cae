"""Spans and runs: intervals merged, islands of equal neighbours, word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearsift.operators.resolve import checkpointed


def _dealt(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows dealt into ranges of (by, order) and written with their range's number, so that a group of any size is many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, F.col(by), *order).withColumn("_range", F.spark_partition_id()))


def _carried(dealt: DataFrame, by: str, inside: Column, over) -> DataFrame:
    """Adds _carry: what a group's ranges before a row's range hand on. `inside` is an aggregate of a range's part of a
    group, `over` makes the carry of those before.

    Only the first group of a range can have begun before it, so that the table of carries has a row for each range at
    most, and its broadcast is bounded.
    """
    parts = dealt.groupBy(by, "_range").agg(inside.alias("_part"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), over("_part", before).alias("_carry")).filter("_carry IS NOT NULL")
    return dealt.join(F.broadcast(carry), (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by", "_at")


#: Rows of a group that one task sorts; larger groups are dealt into ranges.
MOST_IN_TASK = 1_000_000


def _fits(rows: DataFrame, by: str, most: int) -> bool:
    """Whether every group has so few rows that one task can sort it: one count by group, of which a single number is returned."""
    return (rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0) <= most


def merge_intervals(rows: DataFrame, by: str, start: str, end: str, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """Overlapping or adjacent intervals of a group become one: by, start, end, n. A null group is a group.

    Groups of bounded size are windows. Where one is larger, groups are worked on in ranges of their starts: the furthest end
    of the ranges before, and how many intervals they begin, are handed on, so that one group may hold all rows.
    """
    rows, whole = rows.select(by, start, end), Window.unboundedPreceding
    if _fits(rows, by, most_in_task):
        order = Window.partitionBy(by).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(whole, -1))
        marked = rows.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
        numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(whole, 0)))
    else:
        order = Window.partitionBy("_range", by).orderBy(start, end)
        dealt = _carried(_dealt(rows, by, [start, end]), by, F.max(end), lambda c, w: F.max(c).over(w))
        reach = F.greatest(F.col("_carry"), F.max(end).over(order.rowsBetween(whole, -1)))
        marked = dealt.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).drop("_carry")
        numbered = _carried(marked, by, F.sum("_new"), lambda c, w: F.sum(c).over(w))
        numbered = numbered.withColumn("_island", F.coalesce("_carry", F.lit(0)) + F.sum("_new").over(order.rowsBetween(whole, 0)))
    return numbered.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def islands(rows: DataFrame, by: str, order: list[str], column: str, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """Adds the number of the run of equal neighbours in a column that a row belongs to; large groups are worked on in ranges."""
    value, whole = F.struct(F.col(column).alias("v")), Window.unboundedPreceding
    if _fits(rows, by, most_in_task):
        w = Window.partitionBy(by).orderBy(*order)
        marked = rows.withColumn("_new", F.when(F.lag(value).over(w)["v"].eqNullSafe(F.col(column)) & (F.row_number().over(w) > 1), F.lit(0)).otherwise(F.lit(1)))
        return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(whole, 0))).drop("_new")
    last = F.max_by(value, F.struct(*order))
    dealt = _carried(_dealt(rows, by, order), by, last, lambda c, x: F.last(c, ignorenulls=True).over(x))
    w = Window.partitionBy("_range", by).orderBy(*order)
    before = F.coalesce(F.lag(value).over(w), F.col("_carry"))
    new = F.when(before.isNull(), F.lit(1)).otherwise((~before["v"].eqNullSafe(F.col(column))).cast("int"))
    marked = dealt.withColumn("_new", new).drop("_carry")
    counted = _carried(marked, by, F.sum("_new"), lambda c, x: F.sum(c).over(x))
    number = F.coalesce("_carry", F.lit(0)) + F.sum("_new").over(w.rowsBetween(whole, 0))
    return counted.withColumn("island", number).drop("_new", "_range", "_carry")


def word_grams(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, gram): the distinct runs of n lower-case words (letters and digits of any script), as 64-bit hashes.

    The steps are columns of their own, so that a word is hashed once and runs are hashed from hashes."""
    words = rows.select(key, F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w)).alias("w"))
    runs = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)])))
    return words.select(key, F.array_distinct(runs).alias("g")).select(key, F.explode_outer("g").alias("gram")).filter("gram IS NOT NULL")


def with_index_map(rows: DataFrame, column: str) -> DataFrame:
    """Adds norm (lower case, white space runs as one blank, none at the ends) and at: of each of its characters the
    place in the text."""
    chars = rows.withColumn("_c", F.split(F.coalesce(column, F.lit("")), ""))
    blank = lambda c: c.rlike(r"(?U)^\s$")
    kept = F.filter(F.transform("_c", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] != "") & (~blank(x["c"]) | ((x["i"] > 0) & ~F.coalesce(blank(F.get("_c", x["i"] - 1)), F.lit(True)))))
    rows = chars.withColumn("_k", kept)
    last = F.element_at("_k", -1)
    rows = rows.withColumn("_k", F.when((F.size("_k") > 0) & blank(last["c"]), F.slice("_k", F.lit(1), F.size("_k") - 1)).otherwise(F.col("_k")))
    norm = F.array_join(F.transform("_k", lambda x: F.when(blank(x["c"]), F.lit(" ")).otherwise(F.lower(x["c"]))), "")
    return rows.withColumns({"norm": norm, "at": F.transform("_k", lambda x: x["i"])}).drop("_c", "_k")
