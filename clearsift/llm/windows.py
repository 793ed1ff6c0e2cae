"""Vectorised work on runs of hashed words, over all documents of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "h", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a list column has at most `most` elements in each, or one row: this bounds a task's memory."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column(column).value_lengths().fill_null(0), dtype=np.int64))
        start, before = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of a common splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of `width` elements from each place; the last width - 1 places wrap and are to be ignored."""
    h = h.view(np.uint64) if h.dtype == np.int64 else h
    total = np.zeros(len(h), np.uint64)
    for j in range(width):
        total = total * _P + np.roll(h, -j)
    return mix(total)


def starts_of_runs(lengths: np.ndarray, width: int) -> np.ndarray:
    """Whether a run of `width` words that begins at each place stays inside its document."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(len(ends)) + width <= ends


def _slide(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width] for every i; beyond the end stands `fill`."""
    out, span = np.append(x, np.full(width, fill, x.dtype)), 1
    while span * 2 <= width:
        out = pick(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    if rest:
        out = pick(out[: len(out) - rest], out[rest:])
    return out[: len(x)]


def minimizers(h: np.ndarray, lengths: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of `window` words.

    Which grams are chosen inside a window depends on its words alone, so that two documents that share a window
    share its chosen grams.
    """
    grams, least = _window_minima(h, lengths, gram, window)
    most = _slide(least[::-1], window - gram + 1, np.maximum, np.uint64(0))[::-1]  # over the windows that hold the place
    at = np.flatnonzero((grams != _TOP) & (most == grams) & (grams != 0))
    return at, grams[at].view(np.int64)


def _window_minima(h: np.ndarray, lengths: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each place (the greatest number where none fits) and the least of each window (0 where none fits)."""
    grams = np.where(starts_of_runs(lengths, gram), run_hashes(h, gram), _TOP)
    least = _slide(grams, window - gram + 1, np.minimum, _TOP)
    return grams, np.where(starts_of_runs(lengths, window), least, np.uint64(0))


def windows_with(h: np.ndarray, places: np.ndarray, lengths: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Starts of the windows whose least gram begins at one of the places."""
    grams, least = _window_minima(h, lengths, gram, window)
    marked = np.full(len(grams), _TOP)
    marked[places] = grams[places]
    return np.flatnonzero((_slide(marked, window - gram + 1, np.minimum, _TOP) == least) & (least != 0) & (least != _TOP))
