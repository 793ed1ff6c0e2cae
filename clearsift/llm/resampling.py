"""Target-distribution importance resampling: documents are drawn by how much more their words look like a target's."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, with_prefix_sums

#: Between words: ASCII but for digits and letters, after A-Z were lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What each byte becomes: A-Z lower case, what stands between words a blank. Bytes beyond ASCII are parts of words.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a text, and words of several texts, that are worked on at a time: bounds a task's memory.
PIECE, BLOCK = 1 << 20, 1 << 17


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


def _zero_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte b in place k of a CRC-32 becomes when n zero bytes follow."""
    step, out = _byte_table(), np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


_MOST = 255
_ZEROS = _zero_tables(_MOST)
_BLANK = np.uint32(zlib.crc32(b" "))


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as if n more zero bytes had come: CRC-32 is linear, so that crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""
    n = n.copy()
    while (far := np.flatnonzero(n > _MOST)).size:
        crc = crc.copy()
        crc[far] = _moved(crc[far], np.full(len(far), _MOST))
        n[far] -= _MOST
    return _ZEROS[n, 0, crc & 255] ^ _ZEROS[n, 1, (crc >> 8) & 255] ^ _ZEROS[n, 2, (crc >> 16) & 255] ^ _ZEROS[n, 3, crc >> 24]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, how many of these were in the piece before): whole texts, long ones in pieces that overlap by two words."""
    for row, text in enumerate(texts):
        clean, start, tail = (text.as_py() or b"").translate(_CLEAN), 0, []
        while start < len(clean):
            stop = clean.find(b" ", start + PIECE)
            stop = len(clean) if stop < 0 else stop
            found = clean[start:stop].split()
            yield row, tail + found, len(tail)
            tail, start = (tail + found)[-2:], stop


def _blocks(texts: pa.Array) -> Iterator[list[tuple[int, list[bytes], int]]]:
    block, n = [], 0
    for piece in _pieces(texts):
        block.append(piece)
        n += len(piece[1])
        if n >= BLOCK:
            yield block
            block, n = [], 0
    if block:
        yield block


def hashed_features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: the row of each feature, its bucket, and whether it is a single word. Features are all runs of 1 to 3 words."""
    for block in _blocks(texts):
        words = [w for _, piece, _ in block for w in piece]
        sizes = np.array([len(piece) for _, piece, _ in block])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(words)) - starts  # of each word in its piece
        fresh = place >= np.repeat([known for _, _, known in block], sizes)
        rows = np.repeat([row for row, _, _ in block], sizes)
        one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        after_blank = _moved(np.full(len(words), _BLANK), length) ^ one
        two = _moved(np.roll(one, 1), length + 1) ^ after_blank  # of the runs that end at each word
        three = _moved(np.roll(two, 1), length + 1) ^ after_blank
        kept = [fresh, fresh & (place >= 1), fresh & (place >= 2)]
        crcs = np.concatenate([x[k] for x, k in zip((one, two, three), kept, strict=True)])
        yield np.concatenate([rows[k] for k in kept]), crcs.astype(np.int64) % buckets, np.arange(len(crcs)) < kept[0].sum()


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket, each text counted `copies` times.

    A task adds up its texts to at most `buckets` rows; only these are exchanged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = np.asarray(batch.column("copies"))
            for rows, bucket, _ in hashed_features(batch.column("text"), buckets):
                np.add.at(total, bucket, copies[rows])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts.select(F.col("text").cast("binary").alias("text"), "copies").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(texts: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln) of its smoothed share in the target over that in all documents. `buckets` rows of counts reach the driver."""
    counts = np.zeros((2, buckets), np.int64)
    for i, table in enumerate((texts, target.select("text", F.lit(1).cast("long").alias("copies")))):
        for row in bucket_counts(table, buckets).collect():
            counts[i, row.bucket] = row.n
    s, t = counts
    ratio = ((t + 1).astype(float) * float(s.sum() + buckets)) / ((s + 1).astype(float) * float(t.sum() + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def text_weights(texts: DataFrame, gains: np.ndarray) -> DataFrame:
    """Each text's digest and copies with n_words, n_features and weight, the sum of its features' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for rows, bucket, single in hashed_features(batch.column("text"), len(gains)):
                np.add.at(weight, rows, gains[bucket])
                features += np.bincount(rows, minlength=len(batch))
                words += np.bincount(rows[single], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), *map(pa.array, (words, features, weight))], ["digest", "copies", "n_words", "n_features", "weight"])

    columns = texts.select("digest", "copies", F.col("text").cast("binary").alias("text"))
    return columns.mapInArrow(weigh, "digest binary, copies long, n_words long, n_features long, weight long")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """Every document's doc_id with n_words, n_features and weight: the sum of the gains of its features' buckets.

    Identical texts are collapsed by grouping full texts; features and weights are made once for each and go back to
    the documents by the texts' SHA-256. A text that holds over a thousandth of all rows has its weight
    broadcast (there are fewer than a thousand such texts), so that no group of copies is one task of the join.
    """
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    texts = durable(texts.withColumn("digest", text_digest(F.col("text"))), "resample-texts")
    known = durable(text_weights(texts, bucket_gains(texts, target, buckets)), "resample-weights")
    rows = known.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    often = F.col("copies") * 1000 > rows
    ids = durable(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "resample-ids")
    hot = F.broadcast(known.filter(often))  # fewer than 1,000 rows
    joined = ids.join(hot, "digest").unionByName(ids.join(hot, "digest", "left_anti").join(known.filter(~often), "digest"))
    return joined.select("doc_id", "n_words", "n_features", "weight")


def resample_to_target(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """Draws percent / 100 of the documents with `least_words` words, without replacement, in proportion to exp(weight / 1000).

    Features are all runs of 1 to 3 words, hashed into `buckets`. A document's weight is the sum of its features'
    gains; noise of its own, a Gumbel number from the seed and its id, is added, and the highest scores are drawn.
    Returns every document's doc_id, n_features, weight, score and rank (1 for the highest; null where it is not
    drawn), and n_words.

    Null, empty and wordless texts have no features, a weight of 0 and are never drawn (unless least_words is 0). A null
    doc_id has the noise of an empty id. Equal scores go by the smaller doc_id, null last; repeated rows are drawn one
    by one. A text of any length is read whole, in pieces. An empty table gives an empty result; an empty target gives
    gains that only smooth. Further columns, whatever their names, are ignored.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    weights = importance_weights(docs, target, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.log(-F.log(uniform)) * -1000.0)
    scored = durable(weights.withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scores")
    long_enough = F.col("n_words") >= least_words
    n = scored.filter(long_enough).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = with_prefix_sums(scored.filter(long_enough), order, {"rank": F.lit(1).cast("long")}, "resample-ranks")
    place = F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1)
    out = ranked.withColumn("rank", place).unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
