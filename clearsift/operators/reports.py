"""Counts, comparisons and samples that reports are made of."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from clearsift.functions.text import clean_page_text, title_key, url_key


def average_with_exclusion(rows: DataFrame, value: str, excluded: Column, *by: str) -> DataFrame:
    """The mean of all rows and the one without those excluded, side by side."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean_all"), F.avg(F.when(~excluded, F.col(value))).alias("mean_kept"), F.count_if(excluded).alias("n_excluded"))


def words_never_read(references: DataFrame, readings: DataFrame) -> DataFrame:
    """Words of each transcript (doc_id, text) that no reading (doc_id, text) holds, not even as a part of a word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    every = readings.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(words("text")))).alias("read"))
    joined = references.select("doc_id", words("text").alias("wanted")).join(every, "doc_id", "left").withColumn("read", F.coalesce("read", F.array().cast("array<string>")))
    return joined.select("doc_id", F.sort_array(F.filter("wanted", lambda w: ~F.exists("read", lambda r: F.contains(r, w)))).alias("never_read"))


def daily_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by day, and tokens for a call: calls (ts, tokens)."""
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("tokens_a_call"))


def allowed_calls(calls: DataFrame, least_gap: float, most_calls: int, most_tokens: int) -> DataFrame:
    """Adds allowed to calls (day, at, seq, tokens): in their order, each at least a gap after the last one that was made,
    within the day's calls and tokens. A refused call costs nothing.

    Each call depends on those made before it: a day is sorted and streams by, and a task holds three numbers of it.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, last, made, spent = None, None, 0, 0
        for batch in batches:
            out = []
            for d, at, tokens in zip(*(batch.column(c).to_pylist() for c in ("day", "at", "tokens")), strict=True):
                if d != day:
                    day, last, made, spent = d, None, 0, 0
                ok = (last is None or at - last >= least_gap) and made < most_calls and spent + tokens <= most_tokens
                if ok:
                    last, made, spent = at, made + 1, spent + tokens
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "allowed"])

    dealt = calls.repartition("day").sortWithinPartitions("day", "at", "seq")
    return dealt.mapInArrow(judge, StructType([*calls.schema.fields, StructField("allowed", BooleanType())]))


def saving_by_variant(rows: DataFrame) -> DataFrame:
    """Of encodings (variant, doc_id, bytes_before, bytes_after, text_changed, level_changed): savings, and how many results changed."""
    saved = 100 * (1 - F.col("bytes_after") / F.col("bytes_before"))
    return rows.groupBy("variant").agg(
        F.avg(saved).alias("mean_saved"), F.median(saved).alias("median_saved"), F.count_if("text_changed").alias("n_text_changed"), F.count_if("level_changed").alias("n_level_changed")
    )


def changed_by_variant(rows: DataFrame) -> DataFrame:
    """(variant, doc_id, changed): a row for each result that an encoding changed, of its text or its level."""
    what = F.explode(F.filter(F.array(F.when(F.col("text_changed"), F.lit("teks")), F.when(F.col("level_changed"), F.lit("tingkat"))), lambda x: x.isNotNull()))
    return rows.select("variant", "doc_id", what.alias("changed"))


def compare_providers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Results of two providers (doc_id, features array, n_false_quotes): how many agree, and false quotes of each."""
    x, y = a.select("doc_id", F.col("features").alias("fa"), F.col("n_false_quotes").alias("qa")), b.select("doc_id", F.col("features").alias("fb"), F.col("n_false_quotes").alias("qb"))
    return x.join(y, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.sort_array("fa") == F.sort_array("fb")).alias("n_equal"), F.sum("qa").alias("false_quotes_a"), F.sum("qb").alias("false_quotes_b"))


def level_tally(results: DataFrame) -> DataFrame:
    """Of results (doc_id, level, n_candidates, source_rank): rows, candidates and first-rank sources by level."""
    return results.groupBy("level").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("candidates"), F.count_if(F.coalesce(F.col("source_rank") == 1, F.lit(False))).alias("source_first"))


def latency_stats(rows: DataFrame, value: str, too_long: Column, *by: str) -> DataFrame:
    """Median, nearest-rank p90, maximum, and how many inputs were cut; no group is gathered."""
    from clearsift.operators.evaluation import nearest_rank_percentile

    p90 = nearest_rank_percentile(rows, value, 0.9, *by).withColumnRenamed("value", "p90")
    stats = rows.groupBy(*by).agg(F.median(value).alias("median"), F.max(value).alias("max"), F.count_if(too_long).alias("n_cut"))
    return stats.join(p90, list(by), "left") if by else stats.crossJoin(p90)


def load_tally(rows: DataFrame) -> DataFrame:
    """A load test (status, seconds): served, refused, median and longest."""
    return rows.agg(F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") == 503).alias("busy"), F.median("seconds").alias("median"), F.max("seconds").alias("max"))


def find_targets(queries: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, article_id, found): the article a query (query_id, url, title) is about, by address key, else title key."""
    by_url = articles.groupBy(url_key(F.col("url")).alias("k")).agg(F.min("article_id").alias("by_url"))
    by_title = articles.groupBy(title_key(F.col("title")).alias("t")).agg(F.min("article_id").alias("by_title"))
    keyed = queries.select("query_id", url_key(F.col("url")).alias("k"), title_key(F.col("title")).alias("t"))
    joined = keyed.join(by_url, "k", "left").join(by_title, "t", "left")
    return joined.select("query_id", F.coalesce("by_url", "by_title").alias("article_id"), F.coalesce("by_url", "by_title").isNotNull().alias("found"))


def quota_sample(rows: DataFrame, quotas: dict[str, int], label: str, key: str) -> DataFrame:
    """The first rows of each label, as many as its quota; labels without one give none."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in quotas.items() for x in p]), F.col(label)), F.lit(0))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(key))).filter(F.col("_k") <= quota).drop("_k")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows with the least keyed digests: the same ones whenever it is asked."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def negative_queries(news: DataFrame, per_outlet: int, seed: int) -> DataFrame:
    """Queries that no article is about: the first two sentences of news (outlet, id, text) without their dateline, of
    60 to 320 characters, so many of each outlet."""
    bare = F.regexp_replace(F.trim("text"), r"^[\p{Lu}][\p{L} .,]{2,40}(?:\([^)]*\))?\s*[-–—]+\s*", "")
    query = F.concat_ws(" ", F.slice(F.split(bare, r"(?<=[.!?])\s+"), 1, 2))
    kept = news.select("outlet", "id", query.alias("query")).filter(F.length("query").between(60, 320))
    lot = F.row_number().over(Window.partitionBy("outlet").orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), "id"))
    return kept.withColumn("k", lot).filter(F.col("k") <= per_outlet).drop("k")


def latest_years(rows: DataFrame, n: int = 3) -> DataFrame:
    """The latest years with rows, and how many."""
    return rows.filter("date IS NOT NULL").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(n)


def token_budget(texts: DataFrame, limits: DataFrame, chars_a_token: float = 3.5) -> DataFrame:
    """What all texts (text) cost each model (model, tokens_a_day, calls_a_day), and how many days that takes."""
    cost = texts.agg(F.count("*").alias("calls"), F.ceil(F.sum(F.length("text")) / chars_a_token).alias("tokens"))  # one row
    days = F.greatest(F.ceil(F.col("tokens") / F.col("tokens_a_day")), F.ceil(F.col("calls") / F.col("calls_a_day")))
    return limits.crossJoin(F.broadcast(cost)).select("model", "calls", "tokens", days.alias("days"))


def carried_forward(lines: DataFrame) -> DataFrame:
    """Addresses of adapters from lines (doc_id, pos, text): each IPv4 line belongs to the last heading before it."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.regexp_extract("text", r"^(\S.*):\s*$", 1), F.lit(""))
    address = F.nullif(F.regexp_extract("text", r"IPv4[^:]*:\s*(\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit(""))
    named = lines.withColumns({"adapter": F.last(heading, ignorenulls=True).over(w), "address": address})
    return named.filter("address IS NOT NULL").select("doc_id", "pos", "adapter", "address")


def prompt_list(features: DataFrame) -> DataFrame:
    """One text of all features (ord, id, explanation) in their order."""
    return features.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(": ", "id", "explanation").alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("prompt"))


def confirm(results: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, n_broken): how many rows break each named condition."""
    counted = results.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n_broken")) for n in checks])))


def comparison_table(results: dict[str, DataFrame], measure: str, value: str) -> DataFrame:
    """One row for each measure, a column for each run: results maps names of runs to (measure, value)."""
    whole = None
    for name, df in results.items():
        named = df.select(F.lit(name).alias("run"), F.col(measure).alias("measure"), F.col(value).alias("value"))
        whole = named if whole is None else whole.unionByName(named)
    return whole.groupBy("measure").pivot("run", sorted(results)).agg(F.first("value"))


def sweep_table(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """What each profile of thresholds does: false alarms by level, recall, and how often the level is the wanted or an allowed one.

    decisions: profile, doc_id, level. expected: doc_id, is_positive, wanted, allowed (array of levels).
    """
    rows = decisions.join(expected, "doc_id")
    positive, level = F.col("is_positive"), F.col("level")
    found = F.count_if(positive & level.isin("kuat", "hati_hati"))
    return rows.groupBy("profile").agg(
        F.count_if(~positive & (level == "kuat")).alias("false_strong"), F.count_if(~positive & (level == "hati_hati")).alias("false_caution"), F.count_if(~positive).alias("n_negative"),
        F.round(F.when(F.count_if(positive) > 0, found / F.count_if(positive)).otherwise(0.0), 6).alias("recall"), F.count_if(positive & (level == "kuat")).alias("true_strong"), F.count_if(positive).alias("n_positive"),
        F.count_if(level == F.col("wanted")).alias("as_wanted"), F.count_if((level == F.col("wanted")) | F.array_contains("allowed", level)).alias("as_allowed"),
    )


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, before, after) of two runs (doc_id, level), where both have a row and the levels differ."""
    joined = before.select("doc_id", F.col("level").alias("before")).join(after.select("doc_id", F.col("level").alias("after")), "doc_id")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))


def article_ids(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds article_id to candidates (url, title): the first article with both, null without one; missing texts count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = articles.groupBy(text("url").alias("_u"), text("title").alias("_t")).agg(F.min("article_id").alias("article_id"))
    return candidates.withColumns({"_u": text("url"), "_t": text("title")}).join(first, ["_u", "_t"], "left").drop("_u", "_t")


def evaluation_report(rows: DataFrame, ranks: DataFrame, slice_column: str, sweep: tuple[DataFrame, DataFrame] | None = None, baseline: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of an evaluation report: confusion, metrics by slice, ranking, and if they are given a sweep of thresholds
    (decisions, expected) and the differences to a baseline (before, after). rows: expected, actual (0 or 1) and the slice."""
    from clearsift.operators.evaluation import confusion, ranking_metrics, slice_metrics

    tables = {
        "confusion": confusion(rows.withColumn("actual", F.col("actual").cast("string")), "expected", "actual", ["0", "1"]),
        "slices": slice_metrics(rows, slice_column),
        "ranking": ranking_metrics(ranks),
    }
    if sweep:
        tables["sweep"] = sweep_table(*sweep)
    if baseline:
        tables["differences"] = differences(*baseline)
    return tables


def length_sorted(texts: DataFrame, partitions: int, column: str = "text") -> DataFrame:
    """Texts dealt into ranges of length and sorted in each, so that batches for a model hold texts of like length.

    There are `partitions` ranges, and as many as Spark shuffles into if that is more, so that a task's share does not depend on
    `partitions` alone; texts of one length may lie in several.
    """
    n, ranges = F.length(column), max(partitions, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartitionByRange(ranges, n, F.xxhash64(column)).sortWithinPartitions(n)


def tokens_by_image(attempts: DataFrame) -> DataFrame:
    """What all attempts at an image cost: of attempts (doc_id, prompt, completion), missing counts being none."""
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return attempts.groupBy("doc_id").agg(F.count("*").alias("attempts"), some("prompt").alias("prompt"), some("completion").alias("completion"))


def restricted_to(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is wanted, and the wanted keys that no row has, each once."""
    ids = wanted.select(key).distinct()
    return rows.join(ids, key, "left_semi"), ids.join(rows, key, "left_anti")


def candidate_articles(articles: DataFrame, label: str, least: int, topic: str | None, per_group: int, seed: int, by: str) -> DataFrame:
    """Articles (id, label, title, narrative and a group) to make texts from: of a label, whose cleaned narrative has a
    least length and no link and, if a topic is asked for, names it; so many of each group by keyed digests."""
    body = clean_page_text(F.col("narrative"))
    fits = (F.col("label") == label) & (F.length(body) >= least) & ~F.contains(F.lower(body), F.lit("http"))
    if topic:
        fits &= F.lower(F.concat_ws(" ", "title", "narrative")).rlike(topic)
    lot = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), "id"))
    return articles.filter(fits).withColumn("k", lot).filter(F.col("k") <= per_group).drop("k")
