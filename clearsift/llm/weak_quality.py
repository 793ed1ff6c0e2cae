"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer on the posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SYMBOLS, durable, words
from .hashed import adam, flat, hashed_terms, sigmoid, within_terms

VOTES = ("length", "word_length", "symbols", "variety", "lines", "endings", "capitals", "marks", "echoes")


@dataclass(frozen=True)
class WeakQualityParams:
    bits: int = 18
    #: At most so many documents, of so many terms in all, are learned from (the bounds of what the driver collects).
    max_training_rows: int = 20_000
    max_training_terms: int = 16_000_000
    em_rounds: int = 200
    #: Votes that each labeller is credited with in each class beforehand, and how many of them are bad: a labeller that
    #: hardly votes keeps these rates, any other its own, whatever the size of the corpus.
    prior_votes: float = 10.0
    bad_on_good: float = 0.02
    bad_on_bad: float = 0.5
    epochs: int = 8
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 23


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, 2 for no opinion."""
    return F.when(bad, F.lit("0")).when(good, F.lit("1")).otherwise(F.lit("2"))


def labelled_votes(docs: DataFrame) -> DataFrame:
    """doc_id, text and the votes of the heuristic labellers as one string, a digit for each of VOTES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"))
    count = F.size("w")
    marks = F.filter("w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))
    echoes = F.filter("w", lambda x, i: x == F.get("w", i - 1))
    facts = base.select(
        "doc_id",
        "text",
        "symbols",
        "capitals",
        count.alias("n"),
        F.length(F.array_join("w", "")).alias("chars"),
        (F.size(F.array_distinct("w")) / F.greatest(count, F.lit(1))).alias("variety"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("n_distinct"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?]\s*$"))).alias("n_ended"),
        (F.size(marks) / F.greatest(count, F.lit(1))).alias("marks"),
        (F.size(echoes) / F.greatest(count, F.lit(1))).alias("echoes"),
    )
    n, chars, n_lines = F.col("n"), F.greatest(F.col("chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean, symbols, capitals = F.col("chars") / F.greatest(n, F.lit(1)), F.col("symbols") / chars, F.col("capitals") / chars
    repeated, ended = 1 - F.col("n_distinct") / n_lines, F.col("n_ended") / n_lines
    # Variety falls with length, so that its bound does too.
    usual = F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(-0.12))
    votes = [
        _vote(n >= 20, n < 1),
        _vote((mean >= 4.2) & (mean <= 6.2), (n >= 20) & ((mean < 3.5) | (mean > 7.0))),
        _vote(symbols < 0.01, symbols > 0.05),
        _vote((n >= 20) & (F.col("variety") >= usual), (n >= 20) & (F.col("variety") < usual * 0.6)),
        _vote((n_lines >= 3) & (repeated < 0.1), (n_lines >= 4) & (repeated > 0.34)),
        _vote(ended >= 0.9, ended < 0.4),
        _vote((capitals > 0) & (capitals < 0.1), (n >= 20) & (capitals > 0.3)),
        _vote((n >= 20) & (F.col("marks") < 0.01), (n >= 20) & (F.col("marks") > 0.04)),
        _vote((n >= 20) & (F.col("echoes") < 0.05), (n >= 20) & (F.col("echoes") > 0.15)),
    ]
    return facts.select("doc_id", "text", F.concat(*votes).alias("votes"))


def label_model(patterns: dict[str, int], p: WeakQualityParams) -> dict[str, float]:
    """EM over the counts of vote patterns: the posterior of being good for each pattern.

    Labellers are independent given the class, each with its own rates of voting good where it votes; no opinion says
    nothing. Every document counts, through its pattern; there are at most 3**len(VOTES) of them. The rates are counted,
    but for the few prior votes of the parameters. The start takes a bad vote for three good ones; class 1 stays the
    good one.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes = np.array([[int(c) for c in k] for k in keys])
    count = np.array([patterns[k] for k in keys], dtype=np.float64)
    one_hot = (votes[:, :, None] == np.arange(2)).astype(np.float64)
    n_good, n_bad = (votes == 1).sum(1), (votes == 0).sum(1)
    good = np.clip((n_good + 0.5) / (n_good + 3 * n_bad + 1.0), 0.05, 0.95)
    usual = np.array([[p.bad_on_bad, 1 - p.bad_on_bad], [p.bad_on_good, 1 - p.bad_on_good]])[:, None, :]
    for _ in range(p.em_rounds):
        weight = np.stack([count * (1 - good), count * good])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        rates = np.einsum("ck,kjv->cjv", weight, one_hot) + p.prior_votes * usual
        rates /= rates.sum(2, keepdims=True)
        joint = np.log(prior)[:, None] + np.einsum("kjv,cjv->ck", one_hot, np.log(rates))
        new = sigmoid(joint[1] - joint[0])
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, good.tolist(), strict=True))


def with_terms(voted: DataFrame, p: WeakQualityParams, *keep: str) -> DataFrame:
    """Hashed terms: lower-cased words, and shapes of words in which letters are a or A and digits 9."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{N}+", "9")
    split = voted.select(*keep, words(F.lower(text)).alias("w"), F.transform(F.array_distinct(words(shape)), lambda s: F.concat(F.lit("\t"), s)).alias("s"))
    return split.select(*keep, hashed_terms(F.concat(F.array_distinct("w"), F.col("s")), p.bits).alias("terms"))


def train_linear(rows: np.ndarray, terms: np.ndarray, soft: np.ndarray, p: WeakQualityParams) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels; a document's terms share one unit of length."""
    n = len(soft)
    if not n:
        return 0.0, np.zeros(1 << p.bits)
    used, at = np.unique(terms, return_inverse=True)
    starts = np.searchsorted(rows, np.arange(n + 1))
    length = 1.0 / np.sqrt(np.maximum(np.diff(starts), 1))
    rng = np.random.default_rng(p.seed)
    mean = float(np.clip(soft.mean(), 1e-3, 1 - 1e-3))
    b, w = np.array([np.log(mean / (1 - mean))]), np.zeros(len(used))
    step = adam([b, w], p.rate)
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for k in range(0, n, p.batch):
            docs = order[k : k + p.batch]
            index = np.concatenate([at[starts[d] : starts[d + 1]] for d in docs])
            owner = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            z = b[0] + np.bincount(owner, w[index], len(docs)) * length[docs]
            e = (sigmoid(z) - soft[docs]) / len(docs)
            step([np.array([e.sum()]), np.bincount(index, (e * length[docs])[owner], len(used)) + p.decay * w])
    weights = np.zeros(1 << p.bits)
    weights[used] = w
    return float(b[0]), weights


def classify_quality(docs: DataFrame, p: WeakQualityParams | None = None) -> DataFrame:
    """Scores every whole text without given labels: doc_id, score in [0, 1] and kept (score >= 0.5).

    Overlapping heuristic labellers vote on all documents; EM over the counts of their patterns estimates how far
    each can be trusted; the posteriors of a bounded sample, that of the least hashes, train a linear scorer on hashed
    terms, which scores all. Each text is read twice, to vote and to score; sampled ones a third time.

    A null or blank text has no words: its labellers hardly vote and its score is the scorer's bias. A very long text
    is scored whole, by its distinct terms. Null ids are scored like others. Repeated rows are scored one by one, and
    learned from once; an empty table gives an empty result; further columns are ignored.
    """
    p = p or WeakQualityParams()
    spark = docs.sparkSession
    lot = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(p.seed))
    tallies = durable(labelled_votes(docs).select("votes", lot.alias("lot")), "weak-votes")
    # One row for each pattern of votes: at most 3 ** len(VOTES).
    patterns = {r["votes"]: r["n"] for r in tallies.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(k, float(v)) for k, v in label_model(patterns, p).items()], "votes string, posterior double")
    chosen = durable(tallies.orderBy("lot", "votes").limit(p.max_training_rows).distinct().join(F.broadcast(table), "votes").select("lot", "posterior"), "weak-sample")
    # At most max_training_rows rows of two numbers.
    sampled = docs.withColumn("lot", lot).join(F.broadcast(chosen), "lot").select("lot", "text", "posterior").dropDuplicates(["lot"])
    sample = within_terms(with_terms(sampled, p, "lot", "posterior"), "lot", p.max_training_terms).orderBy("lot").select("posterior", "terms").toArrow()
    ids = flat(sample["terms"])
    model = spark.sparkContext.broadcast(train_linear(*ids, np.asarray(sample["posterior"], dtype=np.float64), p))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model.value
        for batch in batches:
            owner, terms = flat(batch.column("terms"))
            n = batch.num_rows
            length = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
            s = sigmoid(bias + np.bincount(owner, weights[terms], n) / length)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = with_terms(docs, p, "doc_id").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)
