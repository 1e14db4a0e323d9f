"""Words of texts and their 64-bit hashes, computed on whole Arrow columns with numpy.

A word is a run of bytes other than space and the five control characters next
to tab. Its hash is a polynomial over random 64-bit values of its bytes, so one
cumulative sum serves all words; a word has the same hash wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BATCH = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 321, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_PLAIN = _SEEDS[:256]
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_POSITION = _SEEDS[256:]

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(
            np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64))))
            for x in (np.uint64(_BASE), np.uint64(inverse))
        )
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and where each text begins; NULL is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        start = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _cut(data: np.ndarray, bounds: np.ndarray, at: int, end: int) -> int:
    """Where a piece that begins at ``at`` ends: never inside a word."""
    stop = at + PIECE
    if stop >= end:
        return end
    bound = int(bounds[np.searchsorted(bounds, stop, "right") - 1])
    gaps = np.flatnonzero(_SEPARATOR[data[at:stop]])
    best = max(bound, at + int(gaps[-1]) + 1 if len(gaps) else 0)
    if best > at:
        return best
    after = int(bounds[np.searchsorted(bounds, stop, "right")])
    while stop < after:
        gaps = np.flatnonzero(_SEPARATOR[data[stop : min(after, stop + PIECE)]])
        if len(gaps):
            return stop + int(gaps[0])
        stop += PIECE
    return after


def split(data: np.ndarray, bounds: np.ndarray, lower: bool):
    """Starts, ends and hashes of all words, and the index of each text's first word."""
    starts, ends, hashes = [], [], []
    at, end = int(bounds[0]), int(bounds[-1])
    values = _LOWER if lower else _PLAIN
    while at < end:
        stop = _cut(data, bounds, at, end)
        piece = data[at:stop]
        gap = _SEPARATOR[piece]
        edge = np.zeros(len(piece) + 1, bool)
        inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop, "right")] - at
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = edge.copy()
        before[1:] |= gap
        after = edge.copy()
        after[:-1] |= gap
        first = np.flatnonzero(~gap & before[:-1])
        last = np.flatnonzero(~gap & after[1:])
        power, inverse = _power_tables(max(len(piece), PIECE))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=total[1:])
        starts.append(first + at)
        ends.append(last + at + 1)
        hashes.append(mix((total[last + 1] - total[first]) * inverse[first]))
        at = stop
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return starts, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(starts, bounds)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; run i begins at word i."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _POSITION[i]
    return mix(total)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a short sequence, apart from those of runs."""
    return mix(runs(hashes, len(hashes)) ^ np.uint64(0x5851F42D4C957F2D))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    With fewer words the whole sequence is the only one; without words none.
    """
    data, bounds = text_bytes(column)
    _, _, hashes, first = split(data, bounds, lower=True)
    all_runs = runs(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(all_runs[a : b - k + 1])
        elif b > a:
            yield whole(hashes[a:b])
        else:
            yield hashes[:0]
