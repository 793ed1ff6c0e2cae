"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Components beyond this are refused: their squared distances would not fit 64 bits.
MOST = 1 << 27


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, none of them null, infinite or not a number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, bad), F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, computed in doubles; one beyond MOST is an error."""
    scaled = lambda x: F.floor(x.cast("double") * float(scale))
    checked = lambda v: F.when(F.abs(v) <= MOST, v).otherwise(F.raise_error(F.lit(f"a component exceeds {MOST} after scaling")).cast("long"))
    return F.transform(vector, lambda x: checked(scaled(x)).cast("int"))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest centroid, the smaller number at ties; exact 64-bit integers."""
    best, least = np.zeros(len(points), np.int32), np.full(len(points), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        gap = points - c
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < least
        best[closer], least[closer] = k, distance[closer]
    return best, least


def _points(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("vector").flatten(), dtype=np.int64).reshape(-1, dims)


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and sums: of the vectors nearest to each centroid their number and sums, each counted as often as it occurs.

    A task adds up its rows to one row for each centroid; only these are exchanged.
    """
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points, times = _points(batch, dims), np.asarray(batch.column("copies"))
            best, _ = nearest(points, centroids)
            for c in np.unique(best):
                mine = best == c
                sums[c] += times[mine] @ points[mine]
                n[c] += times[mine].sum()
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = distinct.select("vector", "copies").mapInArrow(add, "cluster int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), *each)


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after the rounds: each becomes the floor of its vectors' mean, one without vectors stays as it is.

    The driver holds the centroids and one row of sums for each, whatever the number of vectors.
    """
    centroids = centroids.copy()
    for _ in range(rounds):
        for row in weighted_sums(distinct, centroids).collect():
            centroids[row.cluster] = [s // row.n for s in row[2:]]
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each distinct vector's `key` and `copies` with its cluster and squared distance."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least = nearest(_points(batch, dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), pa.array(best), pa.array(least)], ["key", "copies", "cluster", "distance"])

    return distinct.select("key", "copies", "vector").mapInArrow(assign, "key binary, copies long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Clusters `embedding` around k centroids: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are quantised to integers; identical ones are grouped with their number, and only distinct vectors go
    through the rounds, with exact weighted sums. Assignments go back to the rows by the SHA-256 of the components; a vector that
    holds over a thousandth of all rows has its assignment broadcast (there are fewer than a thousand such vectors).

    Centroids start as the vectors of the k least SHA-256 of "seed:vec_id" (a null vec_id as an empty one; repeated ids
    by their components). Equal distances go to the smaller number; a centroid without vectors stays. Vectors that are null, of
    another length, or with a component that is null or not finite are left out; with fewer than k vectors there are as many
    centroids. Repeated rows count and are returned one by one. An empty table, or one without a usable vector,
    gives an empty result. Further columns, whatever their names, are ignored. Components
    beyond 2**27 after scaling stop the query, as their distances fit no 64-bit integer.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col("embedding"), dims)).select("vec_id", quantised(F.col("embedding"), scale).alias("vector"))
    key = F.unhex(F.sha2(F.concat_ws(",", F.transform("vector", lambda v: v.cast("string"))), 256))
    kept = durable(kept.withColumn("key", key), "cluster-vectors")
    distinct = durable(kept.groupBy("vector", "key").agg(F.count("*").alias("copies")), "cluster-distinct")
    chosen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = kept.select(chosen.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema)
    centroids = lloyd(distinct, np.array([r.vector for r in starts], dtype=np.int64), rounds)
    found = durable(assigned(distinct, centroids), "cluster-assigned")
    middle = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("copies")).alias("cluster_inertia"), F.sum("copies").alias("n")).collect()  # k rows
    inertia, rows = sum(r.cluster_inertia for r in by_cluster), sum(r.n for r in by_cluster)
    totals = spark.createDataFrame([(r.cluster, r.cluster_inertia) for r in by_cluster], "cluster int, cluster_inertia long")
    facts = middle.join(totals, "cluster").select("cluster", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    often = F.col("copies") * 1000 > rows
    hot = F.broadcast(found.filter(often))  # fewer than 1,000 rows
    ids = kept.select("vec_id", "key")
    joined = ids.join(hot, "key").unionByName(ids.join(hot, "key", "left_anti").join(found.filter(~often), "key"))
    return joined.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
