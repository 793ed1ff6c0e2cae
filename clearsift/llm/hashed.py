"""Hashed text features for the learned operators: term ids are made by Spark, sums over them by numpy in the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed_terms(tokens: Column, bits: int, prefix: int = 0) -> Column:
    """Distinct ids in [0, 2**bits) of an array column of tokens, and of the tokens' first `prefix` characters too."""
    bucket = lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - bits).cast("int")
    ids = F.transform(tokens, lambda t: bucket(t))
    if prefix:
        ids = F.concat(ids, F.transform(tokens, lambda t: bucket(F.concat(F.lit("^"), F.substring(t, 1, prefix)))))
    return F.array_distinct(ids)


def within_terms(sample: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows of a bounded sample whose `terms` number `most` or fewer in all: this bounds its bytes too."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sample.withColumn("_sum", F.sum(F.size("terms").cast("long")).over(before)).filter(F.col("_sum") <= most).drop("_sum")


def flat(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: the row number of each element, and the elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.repeat(np.arange(len(column)), lengths), np.asarray(column.flatten())


def adam(params: list[np.ndarray], rate: float):
    """Returns a function that takes a step of Adam along the given gradients, in place."""
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def update(gradients: list[np.ndarray]) -> None:
        nonlocal step
        step += 1
        for p, g, m, v in zip(params, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    return update


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
