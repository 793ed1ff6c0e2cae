"""Importance resampling against brute force, on documents with the difficult cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from fixtures import SCHEMA, documents, frame

from clearsift.llm import resampling
from clearsift.llm.resampling import resample_to_target

NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
TARGET = [(1, "w1 w2 w3 w4 w5 w6"), (2, None), (3, ""), (4, "W7, w8; w9! w1 w2"), (4, "W7, w8; w9! w1 w2"), (None, "é à ü w11")]


def features(text):
    w = [x for x in NOT_WORD.split((text or "").translate(UPPER)) if x]
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, least=20, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for _, text in target:
        t.update(map(bucket, features(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for d, text in rows:
        w, f = features(text)
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def target(spark):
    rows = [(i, t, 1.0, "clash") for i, t in TARGET]
    return spark.createDataFrame(rows, "item_id long, text string, score double, digest string")


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words) for r in df.collect())


@pytest.mark.parametrize("percent", [5, 60])
def test_equals_brute_force(spark, target, percent):
    rows = documents() + [(500 + k, "w1 w2 w3 " * 10, *["x"] * 2, 1, "clash", -1, 0.5, "clash") for k in range(40)]
    expected = brute([r[:2] for r in rows], TARGET, percent)
    assert got(resample_to_target(frame(spark, rows), target, percent)) == expected
    assert sum(r[4] is not None for r in expected.elements()) > 0


def test_a_text_longer_than_a_block(spark, target):
    rows = [(i, " ".join(f"w{j * 7 % 13}" for j in range(i))) for i in range(24)] + [(30, "w1 " * 150_000)]
    assert got(resample_to_target(spark.createDataFrame(rows, "doc_id long, text string"), target)) == brute(rows, TARGET)


def test_runs_are_hashed_like_their_bytes(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 9)
    monkeypatch.setattr(resampling, "BLOCK", 7)
    texts = ["", "A b", "é à ü w11", "x" * 700 + " y " + "z" * 256, "one two, three; FOUR-five  six"]
    found = Counter()
    for rows, buckets, single in resampling.hashed_features(pa.array([t.encode() for t in texts]), 1 << 32):
        found.update(zip(rows.tolist(), buckets.tolist()))
        assert single.sum() <= len(rows)
    assert found == Counter((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in features(t)[1])


def test_empty_tables(spark, target):
    assert resample_to_target(frame(spark, []), target).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b c " * 9), (2, None)]
    assert got(resample_to_target(spark.createDataFrame(rows, "doc_id long, text string"), nothing)) == brute(rows, [])


def test_copies_share_their_weight_and_differ_in_noise(spark, target):
    """Two thousand copies of one text go the way of hot texts, ten other texts the way of the rest."""
    rows = [(i, "w1 w2 w3 w4 " * 6) for i in range(2000)] + [(3000 + i, f"v{i} w{i} " * 12) for i in range(10)]
    out = resample_to_target(spark.createDataFrame(rows, "doc_id long, text string"), target)
    assert got(out) == brute(rows, TARGET)
    assert len({r.score for r in out.collect() if r.doc_id < 2000}) > 1000


def test_clashing_columns_are_ignored(spark, target):
    odd = spark.createDataFrame([(1, "w1 w2 " * 12, b"x", 1, 1, 1)], "doc_id long, text string, digest binary, copies int, rank int, bucket int")
    assert got(resample_to_target(odd, target)) == brute([(1, "w1 w2 " * 12)], TARGET)
    assert SCHEMA
