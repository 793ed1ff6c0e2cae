"""Metrics of rankings, levels and detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearsift.operators.resolve import checkpointed


def ranking_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """rank@1, rank@5 and MRR of targets (rank, null if missing)."""
    hit = lambda k: F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False)))
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"), hit(1).alias("at_1"), hit(5).alias("at_5"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    )


def gap_first_second(scores: DataFrame) -> DataFrame:
    """Of each query: the best score and its distance from the next."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return scores.withColumn("gap", F.round(F.col("score") - F.lead("score").over(w), 6)).filter("rank = 1").select("query_id", "score", "gap")


def score_distribution(values: DataFrame, column: str, *by: str) -> DataFrame:
    """min, p10, p50, p90, max, interpolated as numpy does."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 5)
    return values.groupBy(*by).agg(F.min(column).alias("min"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max(column).alias("max"))


def nearest_rank_percentile(values: DataFrame, column: str, share: float, *by: str) -> DataFrame:
    """The value at rank round(share * (n - 1)), half to even. A value's rank comes from a window over its group's
    counts of distinct values, so that no group is gathered."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(column)
    placed = counts.withColumns({"last": F.sum("c").over(upto), "n": F.sum("c").over(group)})
    target = F.bround(F.lit(share) * (F.col("n") - 1), 0)
    return placed.filter((F.col("last") > target) & (F.col("last") - F.col("c") <= target)).select(*by, F.col(column).alias("value"))


def threshold_from_negatives(scores: DataFrame, share: float = 0.95) -> DataFrame:
    """The share of positives above the negatives' percentile and above their maximum. scores: score, is_positive."""
    negatives = scores.filter("NOT is_positive").agg(F.round(F.percentile("score", F.lit(share)), 6).alias("p"), F.max("score").alias("top"))
    positives = scores.filter("is_positive").crossJoin(F.broadcast(negatives))  # one row
    return positives.groupBy("p", "top").agg(
        F.round(F.avg((F.col("score") >= F.col("p")).cast("double")), 6).alias("recall_at_p"), F.round(F.avg((F.col("score") > F.col("top")).cast("double")), 6).alias("recall_above_top")
    )


def confusion(rows: DataFrame, expected: str, actual: str, values: list[str]) -> DataFrame:
    """Counts by expected (rows) and actual (columns); other actual values in a bucket of their own."""
    known = F.when(F.col(actual).isin(*values), F.col(actual)).otherwise(F.lit("lain"))
    wide = rows.groupBy(F.col(expected).alias("expected")).agg(*[F.count_if(known == v).alias(f"n_{v}") for v in [*values, "lain"]])
    return wide


def slice_metrics(rows: DataFrame, slice_column: str) -> DataFrame:
    """Exact matches, false positives and recall for all rows and for each slice in one pass (grouping sets)."""
    hit = lambda e, a: F.count_if((F.col("expected") == e) & (F.col("actual") == a))
    positives = F.nullif(F.count_if(F.col("expected") == 1), F.lit(0))
    return rows.groupingSets([[], [slice_column]], slice_column).agg(
        F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("actual")).alias("exact"), hit(0, 1).alias("false_positives"), hit(1, 1).alias("true_positives"), F.round(hit(1, 1) / positives, 6).alias("recall")
    ).select(F.coalesce(F.col(slice_column).cast("string"), F.lit("semua")).alias("part"), "n", "exact", "false_positives", "true_positives", "recall")


def detector_counts(found: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """False-flag study: for each feature, label and strength the texts that have it, their share of the class, and
    the first three ids. found: doc_id, feature_id, strength; labels: doc_id, label; texts: doc_id."""
    total = labels.join(texts, "doc_id", "left_semi").groupBy("label").agg(F.count("*").alias("n_class"))
    hits = found.select("doc_id", "feature_id", "strength").distinct().join(labels, "doc_id")
    first = Window.partitionBy("feature_id", "label", "strength").orderBy("doc_id")
    return (
        hits.withColumn("k", F.row_number().over(first))
        .groupBy("feature_id", "label", "strength")
        .agg(F.count("*").alias("n_texts"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("doc_id")))).alias("examples"))
        .join(total, "label")
        .withColumn("percent", F.round(100 * F.col("n_texts") / F.col("n_class"), 2))
    )


def model_scorecard(calls: DataFrame) -> DataFrame:
    """For each model: valid and honest shares, median and nearest-rank p95 of the latency, refused calls.

    calls: model, valid, quotes_found, quotes, latency, status."""
    p95 = nearest_rank_percentile(calls, "latency", 0.95, "model").withColumnRenamed("value", "latency_p95")
    return calls.groupBy("model").agg(
        F.count("*").alias("n"),
        F.round(100 * F.avg(F.col("valid").cast("double")), 2).alias("valid_percent"),
        F.round(100 * F.sum("quotes_found") / F.nullif(F.sum("quotes"), F.lit(0)), 2).alias("honest_percent"),
        F.median("latency").alias("latency_median"),
        F.count_if(F.col("status") == 429).alias("n_refused"),
    ).join(p95, "model", "left")


def rule_model_agreement(rules: DataFrame, model: DataFrame, texts: DataFrame) -> DataFrame:
    """Of each feature (doc_id, feature_id) in how many texts (doc_id) both found it, only one, or neither."""
    marks = rules.select("doc_id", "feature_id", F.lit(True).alias("r")).distinct().join(model.select("doc_id", "feature_id", F.lit(True).alias("m")).distinct(), ["doc_id", "feature_id"], "full")
    counted = marks.join(texts, "doc_id", "left_semi").groupBy("feature_id").agg(
        F.count_if(F.col("r").isNotNull() & F.col("m").isNotNull()).alias("both"), F.count_if(F.col("m").isNull()).alias("rules_only"), F.count_if(F.col("r").isNull()).alias("model_only"), F.count("*").alias("n")
    )
    total = texts.agg(F.count("*").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("feature_id", "both", "rules_only", "model_only", (F.col("total") - F.col("n")).alias("neither"))


def most_flagged(counts: DataFrame, label: int, n: int = 6) -> DataFrame:
    """The features that flag most texts of a label, the first n: of counts (feature_id, label, n_texts)."""
    return counts.filter(F.col("label") == label).groupBy("feature_id").agg(F.sum("n_texts").alias("n_texts")).orderBy(F.desc("n_texts"), "feature_id").limit(n)


def run_stability(runs: DataFrame) -> DataFrame:
    """How runs of the same input agree. runs: code, run, claim, features array. The ids that not all runs have."""
    union = F.aggregate("all", F.array().cast("array<string>"), lambda a, x: F.array_union(a, x))
    common = F.aggregate("all", F.get("all", 0), lambda a, x: F.array_intersect(a, x))
    grouped = runs.groupBy("code").agg(F.collect_list("features").alias("all"), F.countDistinct("claim").alias("n_claims"), F.count("*").alias("n_runs"))
    return grouped.select("code", "n_runs", (F.col("n_claims") <= 1).alias("same_claim"), F.sort_array(F.array_except(union, common)).alias("unstable"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two runs, missing ones included."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def ids_where(rows: DataFrame, condition: Column, by: str, id_column: str = "doc_id") -> DataFrame:
    """(group, place, id): the ids of the rows of each group that fulfil a condition, in order, a row for each; a group without
    any has one row without an id. Ids lie in ranges, whose counts are a row for each range and group; nothing is gathered."""
    found = rows.filter(condition).select(F.col(by), F.col(id_column).alias("id"))
    ranged = checkpointed(found.repartitionByRange(by, "id").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(by, "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range", by).orderBy("id"))
    placed = ranged.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))).select(by, (inside + F.col("_start")).alias("place"), "id")
    groups = rows.select(F.col(by).alias("_g")).distinct()
    return groups.join(placed, F.col("_g").eqNullSafe(F.col(by)), "left").select(F.col("_g").alias(by), "place", "id")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """Adds is_test: in every stratum of two or more rows the share (rounded, one at least) with the least keyed digests."""
    w = Window.partitionBy(stratum)
    lot = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return (
        rows.withColumns({"_at": F.row_number().over(w.orderBy(lot, key)), "_n": F.count("*").over(w)})
        .withColumn("is_test", (F.col("_n") >= 2) & (F.col("_at") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n") + 0.5))))
        .drop("_at", "_n")
    )


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, dealt over the strata in turn, in the order of keyed digests."""
    lot = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(lot, key))
    return rows.withColumn("turn", turn).orderBy("turn", stratum).limit(n)
