"""Incremental ingest as a stream: each article once, failed ones tried again, state by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from clearsift.functions.dates_numbers import year_bucket
from clearsift.functions.text import url_key


def new_articles(stream: DataFrame, since: str | None = None, lateness: str = "30 days") -> DataFrame:
    """Rows of a stream (url, error, crawled_at timestamp, date) that succeeded, each address once within the lateness."""
    good = stream.filter("error IS NULL").withColumn("url_key", url_key(F.col("url")))
    if since:
        good = good.filter(F.col("date").isNull() | (F.col("date") >= F.lit(since).cast("date")))
    return good.withWatermark("crawled_at", lateness).dropDuplicatesWithinWatermark(["url_key"])


def unseen(batch: DataFrame, bronze: DataFrame) -> DataFrame:
    """Rows of a batch whose address has no successful row yet: a failed one does not count as seen."""
    seen = bronze.filter("error IS NULL").select(url_key(F.col("url")).alias("k")).distinct()
    return batch.withColumn("k", url_key(F.col("url"))).join(seen, "k", "left_anti").drop("k")


def pages_to_fetch(listing: DataFrame, bronze: DataFrame, cutoff: str, stop_after: int) -> DataFrame:
    """The listed articles to fetch (source, page, url, date): new ones from the cut-off date on, up to the page where
    `stop_after` pages in a row had none.

    A crawl of a listing from its first page on stops there, and goes on from there when it is repeated, as what it
    fetched is no longer new."""
    fresh = unseen(listing.select("source", "page", "url", "date"), bronze).filter(F.col("date").isNull() | (F.col("date") >= F.lit(cutoff).cast("date")))
    pages = listing.select("source", "page").distinct().join(fresh.groupBy("source", "page").agg(F.count("*").alias("n")), ["source", "page"], "left")
    order = Window.partitionBy("source").orderBy("page")
    idle = F.count_if(F.col("n").isNotNull()).over(order.rowsBetween(-(stop_after - 1), 0)) == 0
    full = F.row_number().over(order) >= stop_after
    stopped = F.max((F.col("idle") & F.col("full")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    open_ = pages.withColumns({"idle": idle, "full": full}).withColumn("stopped", stopped).filter("stopped = 0").select("source", "page")
    return fresh.join(open_, ["source", "page"], "left_semi")


def fetched_by_year(bronze: DataFrame) -> DataFrame:
    """How many articles of each year are fetched, those without a date apart."""
    return bronze.filter("error IS NULL").groupBy(year_bucket(F.col("date")).alias("year")).agg(F.count("*").alias("n"))


def cache_misses(inputs: DataFrame, cache: DataFrame, config_version: str, content: str = "text") -> DataFrame:
    """Inputs whose content and configuration have no cached result: cache has key."""
    keyed = inputs.withColumn("key", F.sha2(F.concat_ws("|", F.lit(config_version), F.coalesce(content, F.lit(""))), 256))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def start_ingest(stream: DataFrame, target: str, checkpoint: str, since: str | None = None) -> StreamingQuery:
    """Appends new articles to a Parquet table, as far as the source has data now."""
    return new_articles(stream, since).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def windowed_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Calls and tokens by window of event time: events (ts, tokens); late rows count until the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window)).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
