"""Toxicity: a factorization machine over hashed terms, with pairwise interactions of terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .hashed import adam, flat, hashed_terms, sigmoid, within_terms


@dataclass(frozen=True)
class ToxicityParams:
    #: Term ids: 2**bits; besides a word, its first `prefix` characters are a term, for inflected and joined forms.
    bits: int = 20
    prefix: int = 4
    #: At most so many labelled documents, of so many terms in all, are learned from (the bounds of what the driver collects).
    max_training_rows: int = 20_000
    max_training_terms: int = 16_000_000
    #: Terms in so many labelled documents are looked at; those that tell the labels apart by this z-score are known, at
    #: most so many.
    least_rows: int = 3
    min_z: float = 4.0
    max_terms: int = 4096
    #: Terms become known, too, if they are in a pair, in so many labelled documents, whose labels the machine misses by
    #: this z-score: pairs of a known term and any other, and of any two of the most frequent terms, so many.
    pair_rows: int = 8
    pair_z: float = 8.0
    frequent: int = 1024
    max_pairs: int = 1024
    factors: int = 8
    epochs: int = 15
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 17


@dataclass(frozen=True)
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over a document's known terms."""

    slots: np.ndarray  # of each term id its place in w and v, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        at = self.slots[terms]
        rows, at = rows[at >= 0], at[at >= 0]
        total = np.full(n, self.bias)
        total += np.bincount(rows, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            total += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return sigmoid(total)


class Sample:
    """Labelled documents by their terms, renumbered to those in `least` documents or more; terms of document i:
    at[starts[i]:starts[i + 1]]. `chunks` gives (lengths, terms) of documents in their order, and is read twice, so that
    only the terms that stay are ever held together."""

    def __init__(self, chunks: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], labels: np.ndarray, least: int, size: int) -> None:
        seen = np.zeros(size, np.int64)
        for _, terms in chunks():
            seen += np.bincount(terms, minlength=size)
        self.names = np.flatnonzero(seen >= least)
        self.labels, self.seen = labels, seen[self.names]
        number = np.full(size, -1, np.int32)
        number[self.names] = np.arange(len(self.names), dtype=np.int32)
        kept, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for n, terms in chunks():
            at = number[terms]
            kept.append(at[at >= 0])
            lengths.append(np.bincount(np.repeat(np.arange(len(n), dtype=np.int32), n)[at >= 0], minlength=len(n)))
        self.at = np.concatenate(kept)
        self.starts = np.append(0, np.cumsum(np.concatenate(lengths)))

    def pieces(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document of each, terms) for runs of documents with about so many terms."""
        i = 0
        while i < len(self.labels):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, side="right")) - 1)
            yield np.repeat(np.arange(i, j), np.diff(self.starts[i : j + 1])), self.at[self.starts[i] : self.starts[j]]
            i = j

    def dense(self, docs: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """A matrix of documents by the terms that have a place."""
        x = np.zeros((len(docs), size), np.float32)
        for i, d in enumerate(docs):
            p = place[self.at[self.starts[d] : self.starts[d + 1]]]
            x[i, p[p >= 0]] = 1.0
        return x


def marginal(sample: Sample, docs: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """The terms that tell the labels of the documents (a mask) apart by themselves."""
    n, positive = int(docs.sum()), float(sample.labels[docs].sum())
    if positive in (0.0, float(n)):
        return np.zeros(0, np.int64)
    seen, hits = np.zeros(len(sample.names)), np.zeros(len(sample.names))
    for rows, at in sample.pieces():
        mine = docs[rows]
        seen += np.bincount(at[mine], minlength=len(seen))
        hits += np.bincount(at[mine], sample.labels[rows[mine]], minlength=len(seen))
    rate = seen / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(hits / positive - (seen - hits) / (n - positive)) / np.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)))
    z = np.where((seen >= p.least_rows) & np.isfinite(z), z, 0.0)
    best = np.argsort(-z, kind="stable")[: p.max_terms]
    return np.sort(best[z[best] >= p.min_z])


def missed_pairs(sample: Sample, score: np.ndarray, known: np.ndarray, p: ToxicityParams) -> list[tuple[int, int, float]]:
    """Pairs of terms, with a sign, that the errors of `score` ask for, by a score test; the clearest come first.

    A word that is common in clean text enters here, if only another word makes it toxic, and so do two words that tell
    nothing alone. Of pairs that stand in the same documents, as a word's and its beginning's do, one is enough.
    """
    error, spread = sample.labels - score, np.maximum(score * (1 - score), 0.01)
    found: dict[tuple[int, float, float], tuple[float, int, int, float]] = {}

    def take(a: int, others: np.ndarray, both: np.ndarray, total: np.ndarray, among: np.ndarray) -> None:
        z = np.abs(total) / np.sqrt(np.maximum(among, 0.01))
        # A term that never stands without the other makes no pair with it.
        proper = (both >= p.pair_rows) & (both < np.minimum(sample.seen[a], sample.seen[others])) & (z >= p.pair_z)
        for i in np.flatnonzero(proper):
            key = (int(both[i]), round(float(total[i]), 4), round(float(among[i]), 4))
            found.setdefault(key, (-float(z[i]), a, int(others[i]), float(np.sign(total[i]))))

    size = len(sample.names)
    # The documents of each known term, from the terms of these alone.
    is_known = np.zeros(size, bool)
    is_known[known] = True
    holders = [(rows[m].astype(np.int32), at[m]) for rows, at in sample.pieces() for m in [is_known[at]]]
    held_by, held = (np.concatenate([x[k] for x in holders]) if holders else np.zeros(0, np.int32) for k in (0, 1))
    order = np.argsort(held, kind="stable")
    held_by, held = held_by[order], held[order]
    every = np.arange(size)
    for a in known:
        docs = held_by[np.searchsorted(held, a) : np.searchsorted(held, a, side="right")]
        lengths = sample.starts[docs + 1] - sample.starts[docs]
        index = sample.at[np.repeat(sample.starts[docs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        sums = [np.bincount(index, np.repeat(x[docs], lengths), size) for x in (error, spread)]
        take(int(a), every, np.bincount(index, minlength=size), *sums)
    common = np.argsort(-np.where(2 * sample.seen < len(error), sample.seen, 0), kind="stable")[: p.frequent]
    common = np.sort(common[sample.seen[common] >= p.pair_rows])
    place = np.full(size, -1, np.int32)
    place[common] = np.arange(len(common))
    sums = np.zeros((3, len(common), len(common)))
    for k in range(0, len(error), 1024):
        docs = np.arange(k, min(k + 1024, len(error)))
        x = sample.dense(docs, place, len(common))
        for i, weight in enumerate((np.ones(len(docs)), error[docs], spread[docs])):
            sums[i] += x.T @ (x * weight[:, None].astype(np.float32))
    for i, a in enumerate(common):
        take(int(a), common[i + 1 :], *sums[:, i, i + 1 :])
    return [x[1:] for x in sorted(found.values())[: p.max_pairs]]


def train(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, p: ToxicityParams) -> FactorizationMachine:
    """Fits the machine on a bounded sample: rows[i], in ascending order, has terms[i]; labels are 0 or 1. One class
    only: its base rate.

    A first machine knows the terms that tell the labels apart alone. Each half is scored by a machine of the other, and
    the terms of the pairs that these miss become known; their factors start in the direction of the pair.
    """
    starts = np.searchsorted(rows, np.arange(len(labels) + 1))
    return train_sample(Sample(lambda: [(np.diff(starts), terms)], labels, p.least_rows, 1 << p.bits), p)


def train_sample(sample: Sample, p: ToxicityParams) -> FactorizationMachine:
    """As train, of a sample."""
    labels = sample.labels
    n, positive = len(labels), float(labels.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else 0.0
    nothing = FactorizationMachine(np.full(1 << p.bits, -1, np.int32), bias, np.zeros(0), np.zeros((0, p.factors)))
    if not len(sample.at) or positive in (0.0, float(n)):
        return nothing
    half = np.random.default_rng(p.seed).permutation(n) % 2 == 0
    score = np.zeros(n)
    for mine in (half, ~half):
        score[mine] = _scores(sample, _fit(sample, ~mine, marginal(sample, ~mine, p), [], p), mine)
    known = marginal(sample, np.ones(n, bool), p)
    pairs = missed_pairs(sample, score, known, p) if p.factors else []
    known = np.union1d(known, np.array([x for a, b, _ in pairs for x in (a, b)], np.int64)).astype(np.int64)
    if not len(known):
        return nothing
    place, b, w, v = _fit(sample, np.ones(n, bool), known, pairs, p)
    nothing.slots[sample.names[place >= 0]] = place[place >= 0]
    return FactorizationMachine(nothing.slots, b, w, v)


def _scores(sample: Sample, fitted: tuple[np.ndarray, float, np.ndarray, np.ndarray], docs: np.ndarray) -> np.ndarray:
    place, b, w, v = fitted
    out = []
    wanted = np.flatnonzero(docs)
    for k in range(0, len(wanted), 1024):
        x = sample.dense(wanted[k : k + 1024], place, len(w))
        out.append(b + x @ w + 0.5 * ((x @ v) ** 2 - x @ (v * v)).sum(1))
    return sigmoid(np.concatenate(out)) if out else np.zeros(0)


def _fit(sample: Sample, docs: np.ndarray, known: np.ndarray, pairs: list[tuple[int, int, float]], p: ToxicityParams) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The places of the known terms, the bias, weights and factors, learned on the documents of the mask."""
    size, wanted = len(known), np.flatnonzero(docs)
    positive = float(sample.labels[docs].sum())
    bias = float(np.log((positive + 0.5) / (len(wanted) - positive + 0.5)))
    place = np.full(len(sample.names), -1, np.int32)
    place[known] = np.arange(size)
    rng = np.random.default_rng(p.seed)
    b, w, v = np.array([bias]), np.zeros(size), rng.normal(0, 0.01, (size, p.factors))
    for k, (one, other, sign) in enumerate(pairs):
        v[place[one], k % p.factors] += 0.1
        v[place[other], k % p.factors] += 0.1 * sign
    if size:
        step = adam([b, w, v], p.rate)
        for _ in range(p.epochs):
            order = rng.permutation(wanted)
            for k in range(0, len(order), p.batch):
                chosen = order[k : k + p.batch]
                x = sample.dense(chosen, place, size)
                xv = x @ v
                z = b[0] + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(1)
                e = (sigmoid(z) - sample.labels[chosen]) / len(chosen)
                gv = x.T @ (e[:, None] * xv) - v * (x.T @ e)[:, None]
                step([np.array([e.sum()]), x.T @ e + p.decay * w, gv + p.decay * v])
    return place, float(b[0]), w, v


def with_terms(docs: DataFrame, p: ToxicityParams) -> DataFrame:
    """doc_id and the hashed terms of the whole text: lower-cased runs of letters and digits, and their beginnings."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return docs.select("doc_id", tokens.alias("t")).select("doc_id", hashed_terms(F.col("t"), p.bits, p.prefix).alias("terms"))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> FactorizationMachine:
    """Learns from labelled documents that are not held out; above the bound, from those with the least hashes."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.max_training_rows)
    chosen = durable(chosen, "tox-sample")
    # At most max_training_rows rows of two numbers: the broadcast and what the driver collects are bounded by it.
    sample = docs.filter("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    first = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    ordered = with_terms(first, p).withColumn("lot", F.xxhash64("doc_id", F.lit(p.seed)))
    terms = within_terms(ordered, "lot", p.max_training_terms).join(F.broadcast(chosen), "doc_id").orderBy("lot", "doc_id").select("terms", "toxic").toArrow()

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chunk in terms["terms"].chunks:
            yield np.asarray(chunk.value_lengths().fill_null(0), dtype=np.int64), np.asarray(chunk.flatten())

    sample = Sample(chunks, np.asarray(terms["toxic"], dtype=np.float64), p.least_rows, 1 << p.bits)
    del terms
    return train_sample(sample, p)


def score_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score in [0, 1], predicted (1 if score >= 0.5).

    The machine learns from `labels.toxic` of the documents whose crc32(doc_id) mod 5 is not 0; labels, language,
    source and id are no inputs of a score. Terms that tell nothing alone are known to the machine if the labels of a pair
    ask for them: one of the two tells the labels apart alone (min_z), or both are among the most frequent terms. A very
    long text is scored whole, by its distinct terms. Of several labels of one document the highest counts, of several
    texts under one id the least is learned from; null labels are skipped. A text without known terms, an empty
    one or null gets the bias alone; a null id is not held out. Without both classes among the labels all scores
    are the smoothed base rate. Repeated rows are scored one by one; an empty table gives an empty result;
    further columns are ignored.
    """
    p = p or ToxicityParams()
    # Plain arrays of sizes that the parameters bound.
    model = docs.sparkSession.sparkContext.broadcast(astuple(fit(docs, labels, p)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*model.value)
        for batch in batches:
            rows, ids = flat(batch.column("terms"))
            s = machine.score(rows, ids, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = with_terms(docs, p).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None) -> DataFrame:
    """The documents that are not predicted toxic, as they are; a document with several rows goes if one is toxic."""
    scores = score_toxicity(docs, labels, p)
    bad = durable(scores.filter("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "toxic")
    return docs.join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")
