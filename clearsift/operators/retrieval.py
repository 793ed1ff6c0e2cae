"""Exact nearest reference articles by embedding, and what is measured on their ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, normalised."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(kept, F.transform(F.get(vectors, 0), lambda x: x.cast("double") * 0), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return normalise(total)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Rows of a block of queries and of a block of the corpus: a task holds one of each, and the scores of so many queries at a time.
QUERY_ROWS, CORPUS_ROWS, SCORED_ROWS = 1024, 8192, 64
_SCORED = "query_id long, doc_id long, score double"


def _best(queries: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of scores the k best of each row, as flat arrays: only what reaches a row's k-th score is sorted."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else -np.inf
    row, column = np.nonzero((scores >= least) & (scores > -np.inf))
    value, doc = scores[row, column], docs[column]
    order = np.lexsort((doc, -value, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return queries[row[kept]], doc[order][kept], value[order][kept]


def _scores(left: pa.Table, right: pa.Table, vectors: np.ndarray, digits: int, apart: bool) -> np.ndarray:
    """Rounded dot products of two blocks, the second one's vectors given; minus infinity for what is excluded."""
    scores = _matrix(left["vector"]) @ vectors.T
    np.round(scores, digits, out=scores)
    scores[np.asarray(left["query_id"])[:, None] == np.asarray(right["doc_id"])[None, :]] = -np.inf
    if apart:
        scores[np.asarray(left["apart"])[:, None] == np.asarray(right["apart"])[None, :]] = -np.inf
    return scores


def _met(left: pa.Table, right: pa.Table, k: int, digits: int, apart: bool) -> pa.Table:
    """The k best of one block for each query of another, a few queries at a time: their scores are all that grows with both."""
    docs, vectors = np.asarray(right["doc_id"]), _matrix(right["vector"])
    parts = [left.slice(at, SCORED_ROWS) for at in range(0, len(left), SCORED_ROWS)] if len(right) else []
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    found += [_best(np.asarray(p["query_id"]), docs, _scores(p, right, vectors, digits, apart), k) for p in parts]
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "doc_id", "score"])


def top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, apart: str | None = None) -> DataFrame:
    """The k best of the corpus for every query, itself left out: query_id, doc_id, score, rank.

    A stated set of queries meets all rows as matrix products that hand on their own k best. Up to QUERY_ROWS queries go to the
    tasks as they are, so that the corpus is scanned once where it lies. More of them meet it in blocks of bounded
    size, whose numbers grow with both sides. Scores are dot products, rounded; ties go to the smaller id. What is
    excluded, by id or by an equal value of the column `apart`, goes before the k are taken.
    """
    more = [F.col(apart).alias("apart")] if apart else []
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), *more)
    d = corpus.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), *more)
    few = q.limit(QUERY_ROWS + 1).toArrow()  # bounded, whatever the number of queries
    met = _scanned(few, d, k, digits, bool(apart)) if len(few) <= QUERY_ROWS else _in_blocks(q, d, k, digits, bool(apart))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scanned(queries: pa.Table, corpus: DataFrame, k: int, digits: int, apart: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _met(queries, pa.Table.from_batches([batch]), k, digits, apart).to_batches()

    return corpus.mapInArrow(scan, _SCORED)


def _in_blocks(q: DataFrame, d: DataFrame, k: int, digits: int, apart: bool) -> DataFrame:
    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return _met(left, right, k, digits, apart)

    blocks = lambda rows, size: max(1, -(-rows.count() // size))
    n_q, n_d = blocks(q, QUERY_ROWS), blocks(d, CORPUS_ROWS)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("i", dealt("query_id", n_q)).withColumn("j", every(n_d))
    right = d.withColumn("j", dealt("doc_id", n_d)).withColumn("i", every(n_q))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(block, _SCORED)


def index_mismatch(meta: DataFrame, vectors: DataFrame, articles: DataFrame) -> DataFrame:
    """Whether an index fits its articles: counts of both, and the fingerprint over ids and passages in order."""
    fingerprint = corpus_fingerprint(articles)
    n = vectors.agg(F.count("*").alias("n_vectors"))
    return meta.crossJoin(n).crossJoin(fingerprint).select(
        (F.col("jumlah") != F.col("n_vectors")).alias("wrong_count"), (F.col("jumlah") != F.col("n_articles")).alias("wrong_articles"), (F.col("teks_sha1") != F.col("fingerprint")).alias("wrong_text")
    )


def corpus_fingerprint(articles: DataFrame) -> DataFrame:
    """(n_articles, fingerprint): a digest of the corpus (id, passage) as a tree, so that no task sees all texts.

    Articles are dealt by their ids' digests into 16**5 groups, these into 16**2, and these make the whole: each level
    digests the digests below it in their order. It is a value of this library's own, the same wherever it is computed.
    """
    sha = lambda c: F.sha1(c.cast("binary"))
    key = sha(F.col("id").cast("string"))
    leaf = articles.select(F.substring(key, 1, 5).alias("g"), sha(F.concat(F.col("id").cast("string"), F.lit("\n"), F.coalesce("passage", F.lit("")), F.lit("\n"))).alias("d"))
    joined = lambda: sha(F.array_join(F.sort_array(F.collect_list("d")), ""))
    groups = leaf.groupBy("g").agg(F.count("*").alias("n"), joined().alias("d"))
    few = groups.groupBy(F.substring("g", 1, 2).alias("g")).agg(F.sum("n").alias("n"), joined().alias("d"))
    return few.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_articles"), F.substring(joined(), 1, 16).alias("fingerprint"))


def document_frequencies(docs: DataFrame, words: Column, keep: Column | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(token, df, idf): ln((n + 1) / (df + 1)) over the distinct words of each document.

    `keep` is a condition on token and judged once for each distinct word, after counting; `wanted` (token) restricts
    the words before they are counted.
    """
    tokens = docs.select(F.explode(F.array_distinct(words)).alias("token"))
    if wanted is not None:
        tokens = tokens.join(wanted, "token", "left_semi")
    counted = tokens.groupBy("token").agg(F.count("*").alias("df"))
    counted = counted if keep is None else counted.filter(keep)
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    return counted.crossJoin(F.broadcast(n)).select("token", "df", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)).alias("idf"))


def title_relevance(pairs: DataFrame, idf: DataFrame, n_docs: Column, misread: bool = False) -> DataFrame:
    """Of pairs (pair_id, title_words, text_words): the weight of title words found in the text, in that of all; 1 of none.

    Title words are few; each is judged beside its text and then looks up its weight by a join, without the text's words. Unseen words
    weigh ln(n + 1). With `misread`, words may differ in misread letters. Where the title words found are known, they are
    a column `held` in place of text_words."""
    from clearsift.functions.arrays import word_in_misread

    if "held" in pairs.columns:
        return _weighed(pairs, lambda t: F.array_contains("held", t), idf, n_docs)
    # Words that may be part of another one have a column of their own, made once for a text and not for each title word.
    pairs = pairs.withColumn("_long", F.filter("text_words", lambda w: F.length(w) >= 5))
    part = lambda t: (F.length(t) >= 5) & F.exists("_long", lambda w: F.contains(w, t) | F.contains(t, w))
    test = lambda t: word_in_misread(t, F.col("text_words")) if misread else F.array_contains("text_words", t) | part(t)
    return _weighed(pairs, test, idf, n_docs)


def _weighed(pairs: DataFrame, test: Callable[[Column], Column], idf: DataFrame, n_docs: Column) -> DataFrame:
    hit = F.transform("title_words", lambda t: F.struct(t.alias("token"), F.coalesce(test(t), F.lit(False)).alias("found")))
    words = pairs.select("pair_id", F.explode_outer(hit).alias("t")).select("pair_id", "t.token", "t.found")
    weighed = words.join(idf.select("token", "idf"), "token", "left").withColumn("w", F.coalesce("idf", F.log(n_docs + 1)))
    return weighed.groupBy("pair_id").agg(
        F.coalesce(F.sum(F.when(F.col("token").isNotNull() & F.col("found"), F.col("w"))), F.lit(0.0)).alias("matched"), F.sum(F.when(F.col("token").isNotNull(), F.col("w"))).alias("all_weight")
    ).select("pair_id", F.coalesce(F.when(F.col("all_weight") > 0, F.col("matched") / F.col("all_weight")), F.lit(1.0)).alias("relevance"))
