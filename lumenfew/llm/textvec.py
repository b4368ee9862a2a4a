"""Vectorised views of a batch of texts: one byte buffer, its words, and 64-bit word hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_R = 0xD6E8FEB86659FD93
_R_INV = pow(_R, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0], filled = 1, 1
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
    return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Cut a batch so that each piece has about ``limit`` text bytes at most (one row at least)."""
    _, offsets = buffer_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


@dataclass
class Words:
    data: np.ndarray  #: all bytes
    offsets: np.ndarray  #: where each document begins, and the end
    space: np.ndarray  #: mask of separators
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: past its last byte
    doc: np.ndarray  #: its document
    first: np.ndarray  #: the index of each document's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hasher(self, data: np.ndarray | None = None):
        """A function from byte spans (start, end) to 64-bit hashes: differences of one polynomial that runs over the buffer."""
        data = self.data if data is None else data
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_R, len(data)), out=run[1:])
        inverse = powers(_R_INV, len(data) + 1)

        def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * _MULT)

        return of

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """The hash of each word."""
        return self.hasher(data)(self.start, self.end)


def words_of(column: pa.Array) -> Words:
    data, offsets = buffer_of(column)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~space
    edge = np.zeros(len(data) + 1, bool)  # documents touch in the buffer
    edge[offsets] = True
    before, here = solid[:-1], solid[1:]
    start = np.flatnonzero((here == 1) & ((before == 0) | edge))
    end = np.flatnonzero((before == 1) & ((here == 0) | edge))
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, space, start, end, doc, first)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def per_doc_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
