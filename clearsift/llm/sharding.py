"""Sharding by global byte-size prefix sums: contiguous shards of near-equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, with_prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in the order of their ids, into `shards` runs of near-equal bytes.

    Size is the text's UTF-8 bytes plus 1. A document belongs to the shard in which its middle byte falls when all
    sizes are laid end to end, so that a shard's size differs from total / shards by less than its first and last
    documents. Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard
    (null under this law).

    A null text has size 1 and the CRC of an empty one. Null ids come last; rows with the same id are ordered by
    CRC and size, and rows equal in all three are interchangeable. An empty table gives an empty result. Further
    columns are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc()]
    placed = with_prefix_sums(narrow, order, {"bytes_before": F.col("size"), "rows_before": F.lit(1).cast("long")}, "shard")
    total = placed.agg(F.sum("size")).first()[0] or 1
    middle = f"((2 * bytes_before + size) * {shards}L) div {2 * total}L"
    placed = durable(placed.withColumn("shard", F.expr(f"least({shards - 1}L, {middle})").cast("int")), "shard-cut")
    starts = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))
    # As many rows as shards: bounded by the parameter.
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
