"""What the operators of this subpackage share: word splitting, durable tables, global prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Between words: the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode and where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/clearsift-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that nothing before it is ever computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds exclusive prefix sums over one global order of all rows, without bringing them into one task.

    Rows are dealt into ranges of the order and written with their range's number; a range's total is one row, so
    the offsets of the ranges are a table of as many rows as there are partitions; inside a range a window adds
    the rest. `order` must be total but for rows that are equal in every column.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = df.withColumns(sums).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = durable(ranged, label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_offset") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: at most as many as shuffle partitions, so the broadcast is bounded.
    return ranged.join(F.broadcast(offsets), "_range").withColumns(
        {c: F.col(f"_{c}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    ).drop("_range", *[f"_{c}_offset" for c in sums])
