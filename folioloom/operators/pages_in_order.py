"""Rows that pass a task page by page: batches are cut so that what a function gets are whole pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def codes(values: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones; -1 for null."""
    if pa.types.is_integer(values.type) and not values.null_count:
        whole = values.to_numpy()
        if len(whole) and whole.min() >= 0:
            return whole.astype(np.int64)
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_pages(n_keys: int, made: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made`` of batches whose first ``n_keys`` columns are a page's key and whose pages stand together; a page that spans batches is held until it ends, so what is held is a batch and a page."""

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda k: tuple(c[k].as_py() for c in batch.columns[:n_keys])  # noqa: B023, E731
            changes = np.any([np.diff(codes(c)) != 0 for c in batch.columns[:n_keys]], axis=0)
            cut = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
            if held and (cut or key(0) != last):
                yield made(together([*held, batch.slice(0, cut)] if cut else held))
                held = []
            elif cut:
                yield made(batch.slice(0, cut))
            held.append(batch.slice(cut))
            last = key(batch.num_rows - 1)
        if held:
            yield made(together(held))

    return run
