"""Words and hashes of many texts at once, as numpy arrays over Arrow's text buffers.

Words are runs of bytes other than space and 09-0D. All arrays are per batch; work
inside a batch goes in pieces of about ``PIECE_BYTES``, so that memory is bounded by
the batch and not by a multiple of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE_BYTES = 1 << 18
BATCH_BYTES = 8 << 20

_SEED = 20240601
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_FACTORS = np.random.default_rng(_SEED + 1).integers(
    0, 1 << 64, 64, dtype=np.uint64
) | np.uint64(1)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes that begin a code point.
LEADING = (np.arange(256) & 0xC0) != 0x80

_BYTE_VALUES = np.random.default_rng(_SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[ord("A") : ord("Z") + 1] = _BYTE_VALUES[ord("a") : ord("z") + 1]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python hold about ``BATCH_BYTES`` at most, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = _powers(_BASE, n)
            self.down = _powers(_BASE_INVERSE, n)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base & _MASK, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of 64-bit ``values``; spans are ordered and do not overlap."""
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        # At least one span, else as many as end within a piece.
        last = max(first + 1, int(np.searchsorted(ends, origin + PIECE_BYTES, "right")))
        size = int(ends[last - 1] - origin)
        _POWERS.reach(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[origin : origin + size] * _POWERS.up[:size], out=sums[1:])
        s, e = starts[first:last] - origin, ends[first:last] - origin
        hashes[first:last] = (sums[e] - sums[s]) * _POWERS.down[np.minimum(s, size - 1)]
        first = last
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False
) -> np.ndarray:
    """``span_hashes`` of byte spans; ``fold_case`` hashes A-Z as a-z."""
    table = _FOLDED_VALUES if fold_case else _BYTE_VALUES
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + PIECE_BYTES, "right")))
        piece = table[data[origin : ends[last - 1]]]
        hashes[first:last] = span_hashes(piece, starts[first:last] - origin, ends[first:last] - origin)
        first = last
    return hashes


@dataclass
class Words:
    """Words of a batch of texts: byte spans, and where the words of each text begin."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        return byte_span_hashes(self.data, self.starts, self.ends, fold_case)


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    inside = ~SEPARATOR[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True  # texts follow each other without a separator
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, those across two texts included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * _POSITION_FACTORS[j]
    return mix(total)


def short_window(hashes: np.ndarray) -> np.uint64:
    """Hash of a text's whole word sequence that is shorter than a window."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        total = (hashes * _POSITION_FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
    return mix(np.array([total], np.uint64))[0]


def shingle_hashes(words: Words, size: int, fold_case: bool) -> Iterator[np.ndarray]:
    """For each text, the hash of every window of ``size`` words, in order, repeats included.

    A text with fewer words gives its whole word sequence as one; one without words gives none.
    """
    hashes = words.hashes(fold_case)
    windows = windows_of(hashes, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield windows[a : b - size + 1]
        elif b > a:
            yield np.array([short_window(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def slices(
    batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` bytes of text, one row at least."""
    _, bounds = text_buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
