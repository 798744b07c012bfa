"""Edit distance of pairs of words up to a cap, counting a swap of neighbours as one; a band of the table for many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows of one matrix, and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    wide = np.full((len(words), int(sizes.max(initial=0))), -1, np.int32)
    filled = np.arange(wide.shape[1]) < sizes[:, None]
    wide[filled] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return wide, sizes


def capped(a: list[str], b: list[str], cap: int) -> np.ndarray:
    """Least number of insertions, losses, changes and swaps of neighbours (no part of which is changed again) from each word of ``a`` to that of ``b``; cap + 1 beyond ``cap``.

    Only places at most ``cap`` from the diagonal can count, so rows of 2 cap + 1 cells are kept for all pairs, three at a time.
    """
    if not a:
        return np.zeros(0, np.int64)
    (x, n), (y, m) = _codes(a), _codes(b)
    out = np.full(len(a), cap + 1, np.int64)
    todo = np.flatnonzero(np.abs(n - m) <= cap)
    out[todo[(n[todo] == 0) | (m[todo] == 0)]] = np.maximum(n, m)[todo[(n[todo] == 0) | (m[todo] == 0)]]
    todo = todo[(n[todo] > 0) & (m[todo] > 0)]
    if not len(todo):
        return out
    x, y, n, m = x[todo], y[todo], n[todo], m[todo]
    pad = np.full((len(todo), cap + 1), -2, np.int32)
    y = np.concatenate([pad, y, pad], 1)  # column j of the table's b is j + cap here
    far = np.full((len(todo), 1), cap + 1, np.int64)
    offs = np.arange(-cap, cap + 1)
    row = np.where(offs >= 0, offs, cap + 1)[None, :].repeat(len(todo), 0)
    row = np.where(offs[None, :] <= m[:, None], row, cap + 1)
    before, done = None, np.full(len(todo), cap + 1, np.int64)
    for i in range(1, x.shape[1] + 1):
        j = i + offs
        inside = (j >= 1) & (j[None, :] <= m[:, None])
        letters = y[:, np.clip(j + cap, 0, y.shape[1] - 1)]
        change = row + (letters != x[:, i - 1 : i])
        lose = np.concatenate([row[:, 1:], far], 1) + 1
        now = np.where(inside, np.minimum(change, lose), cap + 1)
        if before is not None:
            last = y[:, np.clip(j + cap - 1, 0, y.shape[1] - 1)]
            swap = (letters == x[:, i - 2 : i - 1]) & (last == x[:, i - 1 : i]) & (j >= 2) & inside
            now = np.where(swap, np.minimum(now, before + 1), now)
        now[:, j == 0] = i
        for k in range(1, 2 * cap + 1):  # what was put in goes along the row
            now[:, k] = np.where(inside[:, k], np.minimum(now[:, k], now[:, k - 1] + 1), now[:, k])
        now = np.minimum(now, cap + 1)
        end = n == i
        at = (m - i + cap)[end]
        done[end] = now[end, at]
        before, row = row, now
    out[todo] = done
    return out


def distances(pairs: DataFrame, a: str, b: str, cap: int) -> DataFrame:
    """``pairs`` with distance of the words in columns ``a`` and ``b``, at most cap + 1; null where one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            there = [k for k, (p, q) in enumerate(zip(one, two)) if p is not None and q is not None]
            found = np.full(batch.num_rows, -1, np.int64)
            found[there] = capped([one[k] for k in there], [two[k] for k in there], cap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=found < 0)], names=[*batch.schema.names, "distance"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields]).add("distance", LongType()))
