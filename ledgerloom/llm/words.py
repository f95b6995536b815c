"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]`` in the UTF-8 text, as
those bytes occur in no longer character.  The hash of a word is a polynomial
over its bytes, taken as the difference of two running sums, then mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.held import give_back

PIECE = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_POW = _powers(int(BASE), PIECE)
_INV = _powers(pow(int(BASE), -1, 1 << 64), PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole of a 64-bit value."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _piece(data: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _POW[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * _INV[starts]


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in joined texts; ``cuts`` are where texts begin."""
    inside = ~BLANK[data]
    first = np.empty(len(data), bool)
    first[:1] = inside[:1]
    first[1:] = inside[1:] & ~inside[:-1]
    at = cuts[cuts < len(data)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = np.empty(len(data), bool)
    last[-1:] = inside[-1:]
    last[:-1] = inside[:-1] & ~inside[1:]
    at = at[at > 0]
    last[at - 1] = inside[at - 1]
    return starts, np.flatnonzero(last) + 1


def parsed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of a string column, the starts and ends of its words, and where each text begins (one more at the end)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    return data, *word_spans(data, bounds[:-1]), bounds


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the words at these places, in order."""
    table, out, k = LOWER if lower else BYTE, np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        j = max(int(np.searchsorted(ends, starts[k] + PIECE, "right")), k + 1)
        base, stop = starts[k], ends[j - 1]
        if stop - base > PIECE:  # one word longer than a piece
            value = np.zeros(1, np.uint64)
            for i in range(base, stop, PIECE):
                part = data[i : min(i + PIECE, stop)]
                value = mix(value + _piece(part, table, np.array([0]), np.array([len(part)])))
            out[k] = value[0]
        else:
            out[k:j] = _piece(data[base:stop], table, starts[k:j] - base, ends[k:j] - base)
        k = j
    return mix(out)


def hashed(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a string column, and where each text's begin (one more at the end).

    A null text has no words."""
    data, starts, ends, bounds = parsed(column)
    return span_hashes(data, starts, ends, lower), np.searchsorted(starts, bounds)


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut to some bytes of text each; a longer text comes alone."""
    for batch in batches:
        give_back()
        if batch.column(text).nbytes <= most:
            yield batch
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def runs(h: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words inside one text, and where each text's begin."""
    count = np.diff(begin)
    valid = np.maximum(count - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(valid)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = total * BASE + h[i : len(h) - k + 1 + i]
    keep = np.ones(len(h), bool)
    for i in range(1, k):
        tail = begin[1:][count >= i] - i
        keep[tail] = False
    return mix(total[keep[: len(total)]]), starts
