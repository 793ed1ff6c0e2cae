"""Writers: JSON lines with nulls kept, versioned replacement, sealed hashes of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.sources.commit_log import CommitLog


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in which null fields are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_versioned(df: DataFrame, root: str) -> str:
    """Writes a new version beside the older ones and returns its path; readers take the one they are told."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def current_version(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """The path and row count of the version that readers take: the last one that was switched to."""
    last = CommitLog(spark, f"{root.rstrip('/')}/versions").latest()
    return (last[1]["path"], last[1]["rows"]) if last else None


def replace_checked(df: DataFrame, root: str, least_share: float = 0.5) -> str:
    """Writes a new version and switches to it, unless it has fewer rows than `least_share` of the present one's.

    The switch is one entry of a commit log, so that readers see the old version or the new one, never a part. Of writers at the
    same time one gets the next number; the others are held against its version and follow it. Older versions
    stay as backups. A refused version raises an error and is left where it was written, unused.
    """
    path = replace_versioned(df, root)
    n = df.sparkSession.read.parquet(path).count()

    def switch(present: dict | None) -> dict:
        if present and n < least_share * present["rows"]:
            raise ValueError(f"{n} rows instead of {present['rows']}: the version {path} is not switched to")
        return {"path": path, "rows": n}

    CommitLog(df.sparkSession, f"{root.rstrip('/')}/versions").append(switch)
    return path


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def row_hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of every row, for a seal."""
    return df.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("sha256"))


def seal_differences(df: DataFrame, key: str, seal: DataFrame) -> DataFrame:
    """Keys whose row changed, appeared or is missing against a seal (key, sha256)."""
    now = row_hashes(df, key).withColumnRenamed("sha256", "now")
    joined = now.join(seal, "key", "full")
    kind = F.when(F.col("now").isNull(), "hilang").when(F.col("sha256").isNull(), "baru").when(F.col("now") != F.col("sha256"), "berubah")
    return joined.select("key", kind.alias("difference")).filter("difference IS NOT NULL")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files, read as bytes by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def envelope(result: DataFrame, error_column: str = "error") -> DataFrame:
    """(doc_id, body): one JSON body for each row, the result or a uniform error."""
    fields = [c for c in result.columns if c not in ("doc_id", error_column)]
    good = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(F.struct(F.col(error_column).alias("kode")).alias("galat")))
    return result.select("doc_id", F.when(F.col(error_column).isNull(), good).otherwise(bad).alias("body"))


def write_vectors(vectors: DataFrame, path: str, variant: str, fingerprint: str) -> None:
    """Vectors as Parquet, and beside them one row that says how many there are, their size and what they were made of."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = vectors.agg(F.count("*").alias("jumlah"), F.max(F.size("embedding")).alias("dimensi"))
    meta.withColumns({"varian": F.lit(variant), "teks_sha1": F.lit(fingerprint)}).write.mode("overwrite").json(f"{path}/meta")
