"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D, so ``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: bytes of text that one pass of numpy work holds
SLICE_BYTES = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def text_column(column: pa.Array) -> pa.Array:
    """Nulls as empty texts."""
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and each text's bounds in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds.astype(np.int64)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row."""
    bounds = buffers(text_column(batch.column(text)))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """All words of some texts: ``raw`` (binary array) and ``first`` (each text's bounds among them)."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = buffers(text_column(column))
        inside = ~BLANK[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = self.bounds[:-1][self.bounds[:-1] < len(self.data)]
        begins[edges] = inside[edges]
        #: where each word begins in the bytes
        self.at = np.flatnonzero(begins)
        before = np.cumsum(inside, dtype=np.int64)
        kept = int(before[-1]) if len(before) else 0
        offsets = np.append(before[self.at] - 1, kept).astype(np.int32)
        self.lengths = np.diff(offsets)
        self.raw = pa.Array.from_buffers(
            pa.binary(), len(self.at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[inside]))]
        )
        self.first = np.searchsorted(self.at, self.bounds)

    def __len__(self) -> int:
        return len(self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Each word's text, by number."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashed(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word; ``lower`` folds A-Z first."""
        coded = self.raw.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if lower:
            distinct = [w.lower() for w in distinct]
        digests = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in distinct]), np.uint64)
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        return (digests[::2][numbers], digests[1::2][numbers]) if len(distinct) else (np.zeros(0, np.uint64),) * 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, by their first; the order of the words counts."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(h), _R, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers)))
    back = np.cumprod(np.full(len(h) - size + 1, _R_INVERSE, np.uint64))
    return mixed((sums[size:] - sums[:-size]) * back)


def within(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the ``size`` words from each place lie in one text (places as in ``rolling``)."""
    ok = np.zeros(total + 1, np.int32)
    lasts = np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, lasts, -1)
    return np.cumsum(ok)[: max(0, total - size + 1)] > 0
