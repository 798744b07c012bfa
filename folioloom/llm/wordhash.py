"""Words and shingles of whole texts as 64-bit hashes, many documents at once with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D; as those are ASCII, UTF-8 bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on together; a longer document is worked on alone.
CHUNK_BYTES = 1 << 20
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits given."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' bytes and offsets (one more than rows); a null text is empty."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary()).cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        own = offsets[row : end + 1]
        yield batch.slice(row, end - row), data[own[0] : own[-1]], own - own[0]
        row = end


class Words:
    """``starts`` and ``ends`` (bytes) of all words of a chunk; those of document i are ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = SPACE[data]
        begin, finish = ~gap, ~gap
        if len(data):
            begin[1:] &= gap[:-1]
            finish[:-1] &= gap[1:]
            full = offsets[1:] > offsets[:-1]
            heads, tails = offsets[:-1][full], offsets[1:][full] - 1
            begin[heads], finish[tails] = ~gap[heads], ~gap[tails]
        self.data, self.starts, self.ends = data, np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = True) -> np.ndarray:
        data = np.concatenate([LOWER[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        left = self.ends - self.starts
        out = left.astype(np.uint64) * _C
        rows, at = np.arange(len(left)), self.starts
        while len(rows):
            out[rows] = mix(out[rows] ^ (eight[at] & _MASK[np.minimum(left, 8)])) + _C
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds by document. short: a document of fewer words has all its words as one."""
    n = np.diff(first)
    counts = np.maximum(n - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    out = np.full(len(start), np.uint64(size))
    for k in range(size):
        out = mix(out + hashes[start + k]) if len(start) else out
    if short and (few := np.flatnonzero((n > 0) & (n < size))).size:
        counts = np.where((n > 0) & (n < size), 1, counts)
        old, bounds_new = bounds, np.concatenate([[0], np.cumsum(counts)])
        whole = np.zeros(bounds_new[-1], np.uint64)
        whole[np.repeat(bounds_new[:-1] - old[:-1], np.diff(old)) + np.arange(old[-1])] = out
        for d in few:
            one = np.uint64(n[d])
            for h in hashes[first[d] : first[d + 1]]:
                one = mix(np.array([one, h]).sum(keepdims=True, dtype=np.uint64))[0]
            whole[bounds_new[d]] = one
        out, bounds = whole, bounds_new
    return out, bounds
