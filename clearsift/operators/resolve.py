"""Cleaning and merging of article rows: best row for each key, backfill, entity resolution over several keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearsift.functions.text import slug_key, title_key, url_key


def best_by_key(rows: DataFrame, key: str, seq: str, *value: Column) -> DataFrame:
    """One row for each key: that of the highest value, of equals the earliest; with first_seq, where the key first stood."""
    rank = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(value)], (-F.col(seq)).alias("earlier"))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("best"), F.min(seq).alias("first_seq"))
    return best.select(key, "best.*", "first_seq")


def first_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The earliest row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "r.*")


def last_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "r.*")


def backfill(rows: DataFrame, key: str, priority: str, columns: list[str]) -> DataFrame:
    """One row for each key: of each column the first filled value by priority."""
    filled = lambda c: F.min_by(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.when(F.trim(F.col(c).cast("string")) != "", F.col(priority)))
    return rows.groupBy(key).agg(*[filled(c).alias(c) for c in columns], F.count("*").alias("n_rows"))


def reject_reason(url: Column, title: Column) -> Column:
    """Rows without an address or a title are rejected, in this order; null for good rows."""
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", F.lit("tanpa url")).when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("tanpa judul"))


def enrich_narrative(articles: DataFrame, narratives: DataFrame) -> DataFrame:
    """Fills narratives by address key; of several for one key the last counts."""
    last = narratives.withColumn("k", url_key(F.col("url"))).groupBy("k").agg(F.max_by("narrative", "seq").alias("looked_up"))
    return articles.withColumn("k", url_key(F.col("url"))).join(last, "k", "left").withColumn("narrative", F.coalesce("looked_up", "narrative")).drop("k", "looked_up")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application, in the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/clearsift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keys(rows: DataFrame, own_domain: str) -> DataFrame:
    """(seq, at, key, offered): the keys by which a row looks for an earlier one, in their order; its own address and
    slug are also offered to later rows."""
    slug = lambda u: F.when(F.contains(F.lower(u), F.lit(own_domain)), slug_key(u))
    entry = lambda at, kind, k, offered: F.when(k != "", F.struct(at.alias("at"), F.concat(F.lit(kind), k).alias("key"), F.lit(offered).alias("offered")))
    refs = F.coalesce("ref_urls", F.array().cast("array<string>"))
    url = F.col("url")
    own = F.array(entry(F.lit(0), "u:", url_key(url), True), entry(F.lit(1), "s:", slug(url), True))
    addresses = F.transform(refs, lambda r, i: entry(i * 2 + 2, "u:", url_key(r), False))
    slugs = F.transform(refs, lambda r, i: entry(i * 2 + 3, "s:", slug(r), False))
    return rows.select("seq", F.inline(F.array_compact(F.concat(own, addresses, slugs))))


def earlier_by_key(rows: DataFrame, own_domain: str) -> DataFrame:
    """(seq, parent, at): of each row that meets an earlier one by a key, the first such row by its first such key."""
    keys = checkpointed(_keys(rows, own_domain))
    first = keys.filter("offered").groupBy("key").agg(F.min("seq").alias("parent"))
    met = keys.join(first, "key").filter("parent < seq")
    return met.groupBy("seq").agg(F.min_by("parent", "at").alias("parent"), F.min("at").alias("at"))


def earlier_by_title(heads: DataFrame, days: int = 7) -> DataFrame:
    """(seq, parent): heads (seq, title, date) that have the title of an earlier one within so many days.

    In the order of a title's heads, each joins the first one kept before that is near in time, or is kept. Heads of
    one date fare alike and are one entry, so that what is folded of a title has at most as many as there are dates.
    """
    titled = heads.select("seq", "date", title_key(F.col("title")).alias("t")).filter(F.length("t") >= 12)
    entries = titled.groupBy("t", "date").agg(F.min("seq").alias("first"))
    none = F.array().cast("array<struct<seq:bigint,date:date,kept:bigint>>")
    near = lambda a, b: a.isNull() | b.isNull() | (F.abs(F.datediff(a, b)) <= days)

    def place(done: Column, e: Column) -> Column:
        home = F.get(F.filter(done, lambda k: (k["seq"] == k["kept"]) & near(k["date"], e["date"])), 0)["seq"]
        return F.concat(done, F.array(F.struct(e["first"].alias("seq"), e["date"].alias("date"), F.coalesce(home, e["first"]).alias("kept"))))

    listed = F.sort_array(F.collect_list(F.struct(F.col("first").cast("bigint").alias("first"), F.col("date").cast("date").alias("date"))))
    placed = entries.groupBy("t").agg(F.aggregate(listed, none, place).alias("e")).select("t", F.inline("e"))
    joined = titled.join(placed.select(F.col("t").alias("pt"), F.col("date").alias("pd"), "kept"), (F.col("t") == F.col("pt")) & F.col("date").eqNullSafe(F.col("pd")))
    return joined.select("seq", F.col("kept").alias("parent")).filter("parent < seq")


def to_roots(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(seq, root): parents are smaller than their rows; paths are followed by doubling, and every round is written."""
    jumps = checkpointed(rows.select("seq").join(parents, "seq", "left").select("seq", F.coalesce("parent", "seq").alias("root")))
    while True:
        up = jumps.alias("x").join(jumps.alias("y"), F.col("x.root") == F.col("y.seq")).select("x.seq", F.col("y.root").alias("root"), (F.col("y.root") != F.col("x.root")).alias("moved"))
        after = checkpointed(up)
        jumps = after.select("seq", "root")
        if not after.filter("moved").limit(1).count():
            return jumps


def merge_links(rows: DataFrame, own_domain: str) -> DataFrame:
    """(seq, parent, reason): the earlier row that each merged row joins, and by what."""
    by_key = checkpointed(earlier_by_key(rows, own_domain))
    heads = to_roots(rows, by_key.select("seq", "parent"))
    dated = rows.join(heads, "seq").groupBy("root").agg(F.min_by("date", F.when(F.col("date").isNotNull(), F.col("seq"))).alias("date"))
    own = rows.select("seq", "title").join(dated.withColumnRenamed("root", "seq"), "seq")
    reason = F.when(F.col("at") == 0, "alamat").when(F.col("at") == 1, "slug").otherwise("rujukan")
    return checkpointed(by_key.select("seq", "parent", reason.alias("reason")).unionByName(earlier_by_title(own).withColumn("reason", F.lit("judul"))))


def resolve_articles(rows: DataFrame, own_domain: str) -> DataFrame:
    """Merges article rows of several sources into one for each article.

    rows: seq (unique, the order of priority), source, url, title, narrative, date, ref_urls. A row joins the first
    earlier row that has its address, else its slug, else an address or slug it refers to; what is left joins by title
    within seven days. A merged row passes on its address and slug, and the first narrative and date that its article
    lacks. Where a kept row has no date, the first date of the rows that join it by keys stands for it in the
    comparison of titles. Returns the kept rows with other_sources (in the order of their first rows) and n_merged.
    """
    members = rows.join(to_roots(rows, merge_links(rows, own_domain).select("seq", "parent")), "seq")
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("seq")))
    merged = members.groupBy("root").agg(filled("narrative").alias("_narrative"), filled("date").alias("_date"), (F.count("*") - 1).alias("n_merged"))
    sources = members.groupBy("root", "source").agg(F.min("seq").alias("first")).groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]).alias("sources"))
    kept = rows.join(merged.withColumnRenamed("root", "seq"), "seq").join(sources.withColumnRenamed("root", "seq"), "seq")
    return kept.select(
        "seq", "source", "url", "title", F.coalesce("_narrative", "narrative").alias("narrative"), F.coalesce("date", "_date").alias("date"),
        F.filter("sources", lambda s: ~s.eqNullSafe(F.col("source"))).alias("other_sources"), F.col("n_merged").cast("long").alias("n_merged"),
    )


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: how many articles, without a date, without a narrative, with an error mark, and duplicates by reason."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(empty("narrative")).alias("no_narrative"), F.count_if(~empty("error")).alias("errors"))


def final_order(rows: DataFrame) -> DataFrame:
    """Latest first, rows without a date last, then by falling id."""
    return rows.orderBy(F.desc_nulls_last("date"), F.desc("id"))


def merge_report(rows: DataFrame) -> DataFrame:
    """Counts by source, label and year and of filled narratives in one pass: part, value, n, n_narrative."""
    year = F.coalesce(F.year("date").cast("string"), F.lit("tanpa tanggal"))
    parts = F.array(*[F.struct(F.lit(name).alias("part"), value.alias("value")) for name, value in (("source", F.col("source")), ("label", F.col("label")), ("year", year))])
    return rows.select(F.inline(parts), F.col("narrative")).groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("narrative", F.lit(""))) != "").alias("n_narrative"))


def adjacent_in(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """Adds prev_, next_ and max_ of a column inside its group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({f"prev_{column}": F.lag(column).over(w), f"next_{column}": F.lead(column).over(w), f"max_{column}": F.max(column).over(Window.partitionBy(by))})
