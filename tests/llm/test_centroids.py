"""Weighted Lloyd rounds against brute force over single vectors."""

import hashlib
import math
import random
from collections import Counter

import pytest

from clearsift.llm.centroids import cluster_vectors

DIMS = 64
SCHEMA = "vec_id long, embedding array<float>, cluster string, copies int, `key` string, label int"


def brute(rows, k=16, rounds=3):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, tuple(math.floor(64 * x) for x in v)))
    if not kept:
        return Counter()
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [r[1] for r in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(groups[i]) for x in zip(*groups[i])) if i in groups else c for i, c in enumerate(centroids)]
    found = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = Counter()
    for _, distance, i in found:
        inertia[i] += distance
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((vec_id, i, distance, inertia[i], sum(inertia.values()), sha[i]) for vec_id, distance, i in found)


def vectors(n, seed=3):
    rng = random.Random(seed)
    dealt = lambda x: [round(x + rng.gauss(0, 0.2), 3) for _ in range(DIMS)]
    rows = [(i, dealt(rng.choice((-1, 0, 1, 2))), "clash", 1, "clash", 0) for i in range(n)]
    return [(i, [float(f"{x:.7g}") for x in v], *r) for i, v, *r in rows]


def single(rows):
    """The values as 32-bit numbers, which is what the table holds."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in rows]


def got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r) for r in df.collect())


def test_equals_brute_force_with_odd_rows(spark):
    rows = vectors(150)
    same = rows[7][1]
    rows += [(1000 + k, same, *rows[7][2:]) for k in range(400)]  # a third of all rows and more
    rows += [rows[3], rows[3], (None, rows[5][1], "x", 1, "x", 1), (None, None, "x", 1, "x", 1), (2000, [], None, None, None, None)]
    rows += [(2001, [0.5] * 63, *rows[0][2:]), (2002, [0.5] * 63 + [None], *rows[0][2:]), (2003, [0.5] * 63 + [math.nan], *rows[0][2:]), (2004, [math.inf] + [0.5] * 63, *rows[0][2:]), (2005, [0.5] * 65, *rows[0][2:])]
    rows = single(rows)
    expected = brute(rows)
    assert sum(expected.values()) == 150 + 400 + 3
    assert got(cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == expected


def test_fewer_vectors_than_centroids_and_ties(spark):
    """Two vectors at the same distance from two centroids, and centroids that stay empty."""
    rows = single([(i, [float(i % 2)] * DIMS, "", 1, "", 1) for i in range(5)])
    assert got(cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    many = single([(i, [float(i % 2)] * DIMS, "", 1, "", 1) for i in range(60)])
    assert got(cluster_vectors(spark.createDataFrame(many, SCHEMA))) == brute(many)


def test_empty_tables(spark):
    assert got(cluster_vectors(spark.createDataFrame([], SCHEMA))) == Counter()
    assert got(cluster_vectors(spark.createDataFrame([(1, None, "", 1, "", 1)], SCHEMA))) == Counter()


def test_what_fits_no_integer_stops_the_query(spark):
    with pytest.raises(Exception, match="a component exceeds"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * DIMS, "", 1, "", 1)], SCHEMA))
