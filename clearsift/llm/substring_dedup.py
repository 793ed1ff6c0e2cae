"""Substring dedup: recurring passages are confirmed, and sharded Aho-Corasick automata locate their occurrences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, words
from .windows import minimizers, pieces, run_hashes, windows_with

#: Words of a gram: enough that two documents seldom share one by chance, few enough that windows choose few.
_GRAM = 7
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: An automaton is compiled when its phrases have so many characters, or the documents that wait for it ten times as
#: many; this bounds a task's memory.
_SHARD_CHARS = 400_000


def _batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten(), dtype=np.int64), lengths


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select("doc_id", *keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def passage_anchors(docs: DataFrame, window: int, with_place: bool) -> DataFrame:
    """The chosen grams of every document: anchor, doc_id and, if asked for, the place in the document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, lengths = _batch_words(batch.column("h"))
            at, anchor = minimizers(h, lengths, _GRAM, window)
            first = np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(lengths)), lengths)[at]
            out = [pa.array(anchor), batch.column("doc_id").take(pa.array(row))]
            if with_place:
                out.append(pa.array((at - first[row]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, ["anchor", "doc_id", "place"][: len(out)])

    return _hashed(docs).mapInArrow(find, "anchor long, doc_id long" + ", place int" * with_place)


def suspect_windows(suspects: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows around the recurring anchors: win, doc_id, start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, lengths = _batch_words(batch.column("h"))
            first = np.cumsum(lengths) - lengths
            places, counts = _batch_words(batch.column("places"))
            at = places + np.repeat(first, counts)
            # With several texts under one id a place may lie in another text; it is left out where it lies beyond the end.
            at = at[places < np.repeat(lengths, counts)]
            starts = windows_with(h, at, lengths, _GRAM, window)
            row = np.repeat(np.arange(len(lengths)), lengths)[starts]
            win = run_hashes(h, window)[starts].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(win), batch.column("doc_id").take(pa.array(row)), pa.array((starts - first[row]).astype(np.int32))], ["win", "doc_id", "start"]
            )

    return _hashed(suspects, "places").mapInArrow(find, "win long, doc_id long, start int")


def merge_runs(marks: DataFrame, window: int) -> DataFrame:
    """Joins windows that follow each other in a document and in their source: doc_id, source, source_start, n."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("found"), strict=True):
                x = found.values
                start, source, at = (np.asarray(x.field(k), dtype=np.int64) for k in ("start", "source", "source_start"))
                order = np.lexsort((at, source, start - at))
                start, source, at = start[order], source[order], at[order]
                new = np.ones(len(start), bool)
                new[1:] = (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)
                heads = np.flatnonzero(new)
                sizes = np.diff(np.append(heads, len(start)))
                rows += [(doc, int(source[i]), int(at[i]), int(n) + window - 1) for i, n in zip(heads, sizes, strict=True)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "source", "source_start", "n"])

    return marks.mapInArrow(merge, "doc_id long, source long, source_start int, n int")


def phrase_texts(sources: DataFrame) -> DataFrame:
    """The words of each phrase, from the document it occurs in first: source, source_start, n, phrase."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for source, text, wanted in zip(batch.column("source").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                w = _WORD.findall(text.as_py() or "")
                out += [(source, x["source_start"], x["n"], " ".join(w[x["source_start"] : x["source_start"] + x["n"]])) for x in wanted]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["source", "source_start", "n", "phrase"])

    return sources.mapInArrow(cut, "source long, source_start int, n int, phrase string")


def _stream(docs: list[tuple[int, str]], phrases: dict[str, int], window: int) -> Iterator[tuple[int, str, int, str]]:
    """Runs each document through the automaton of the phrases; a phrase counts if its source has a smaller id."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, source in phrases.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, source))
    if len(automaton):
        automaton.make_automaton()
    for doc, text in docs:
        w = _WORD.findall(text)
        starts = np.cumsum([0] + [len(x) + 1 for x in w])
        gone = np.zeros(len(w) + 1, np.int64)
        for end, (size, source) in automaton.iter(f" {' '.join(w)} ") if len(automaton) else ():
            if source < doc:
                # The match begins at the blank before its first word, which is where that word stands without it.
                a, b = np.searchsorted(starts, (end - size + 1, end))
                gone[a] += 1
                gone[b] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        kept = " ".join(x for x, c in zip(w, covered.tolist(), strict=True) if not c)
        before = hashlib.sha256(" ".join(w).encode()).hexdigest()
        yield doc, before, int(covered.sum()), hashlib.sha256(kept.encode()).hexdigest()


def locate(docs: DataFrame, window: int) -> DataFrame:
    """Streams documents (doc_id, text, phrases) through automata of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "text_sha256", "n_removed", "kept_sha256"], (pa.int64(), pa.string(), pa.int64(), pa.string())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_stream(held, phrases, window), strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        held: list[tuple[int, str]] = []
        phrases: dict[str, int] = {}
        chars = waiting = 0
        for batch in batches:
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("phrases"), strict=True):
                held.append((doc, text.as_py() or ""))
                waiting += len(held[-1][1])
                for x in own.as_py():
                    if x["phrase"] not in phrases:
                        chars += len(x["phrase"])
                    phrases[x["phrase"]] = min(x["source"], phrases.get(x["phrase"], x["source"]))
                if chars >= _SHARD_CHARS or waiting >= 10 * _SHARD_CHARS:
                    yield flush()
                    held, phrases, chars, waiting = [], {}, 0, 0
        yield flush()

    return docs.mapInArrow(run, "doc_id long, text_sha256 string, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """Removes each word covered by a run of `window` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by blanks). Steps: texts with the
    same words are one, and all but the least id lose every word; of the others, grams chosen by content (the least
    of each window) find passages that recur; the windows around them are confirmed and merged into phrases; each
    group of documents is streamed through an automaton of the phrases that occur in it, which finds every
    occurrence by the words themselves, so that equal hashes alone remove nothing.

    A null or blank text has no words. Of a very long text as many windows are looked at as it has. A null id is kept whole and removes nothing. Several rows of one id are one
    document with several texts: each is judged by itself, only against smaller ids. An empty table gives an empty
    result; further columns are ignored.
    """
    if window < _GRAM:
        raise ValueError(f"window must be at least {_GRAM}")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = base.select("doc_id", words(F.col("text")).alias("w"))
    facts = durable(split.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("text_sha256")), "dedup-facts")
    long_enough = facts.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = durable(long_enough.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id"), "dedup-first")
    # Copies: a table of ids and digests, compared by both, as one id may have several texts.
    copies = durable(long_enough.join(first, "text_sha256").filter("doc_id > first_id").select("doc_id", "text_sha256").distinct(), "dedup-copies")
    only_copy = copies.select("doc_id").join(facts.join(copies, ["doc_id", "text_sha256"], "left_anti").select("doc_id"), "doc_id", "left_anti").distinct()
    whole = base.filter("doc_id IS NOT NULL").join(durable(only_copy, "dedup-skipped"), "doc_id", "left_anti")

    # Which grams occur twice; counts alone are exchanged. The result is written, so that both sides of the join with it
    # are plain exchanges that Spark can split.
    counted = passage_anchors(whole, window, False).groupBy("anchor").agg(F.count("*").alias("n"))
    recurring = durable(counted.filter("n > 1").select("anchor"), "dedup-anchors")
    hits = passage_anchors(whole, window, True).join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    suspects = durable(whole.join(hits, "doc_id"), "dedup-suspects")

    found = suspect_windows(suspects, window)
    least = found.groupBy("win").agg(F.min(F.struct(F.col("doc_id").alias("source"), F.col("start").alias("source_start"))).alias("first"), F.max("doc_id").alias("last"))
    confirmed = durable(least.filter("first.source < last").select("win", "first.source", "first.source_start"), "dedup-windows")
    later = found.join(confirmed, "win").filter("source < doc_id")
    marks = later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "source", "source_start")).alias("found"))
    runs = durable(merge_runs(marks, window), "dedup-runs")

    wanted = runs.select("source", "source_start", "n").distinct().groupBy("source").agg(F.collect_list(F.struct("source_start", "n")).alias("wanted"))
    sources = wanted.join(suspects.select(F.col("doc_id").alias("source"), "text"), "source")
    phrases = durable(phrase_texts(sources), "dedup-phrases")
    own = runs.join(phrases, ["source", "source_start", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("source", "phrase")).alias("phrases"))
    removed = durable(locate(suspects.select("doc_id", "text").join(own, "doc_id"), window), "dedup-removed")

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    is_copy = F.col("c.doc_id").isNotNull()
    changed = removed.dropDuplicates(["doc_id", "text_sha256"])
    return (
        facts.alias("f")
        .join(copies.alias("c"), ["doc_id", "text_sha256"], "left")
        .join(changed.alias("r"), ["doc_id", "text_sha256"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(is_copy, nothing).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
        )
    )
