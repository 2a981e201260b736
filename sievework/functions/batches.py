"""Arrow batches in slices of bounded rows and bytes, and the k best scores that a task has seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice, and its text's bytes beyond the first row: what a Python worker turns into objects at once.
ROWS, BYTES = 256, 1 << 20
#: Scores held at once.
SCORES = 1 << 19


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value: of a text, a number, or all that a list holds."""
    if pa.types.is_list(column.type):
        inner = np.concatenate([[0], np.cumsum(_sizes(column.flatten()))])
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        return np.diff(inner[ends], prepend=0)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def sliced(batches: Iterator[pa.RecordBatch], by: int, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that a slice has at most `rows` rows and, unless it is one row, `most` bytes in the column `by`."""
    for b in batches:
        ends = np.cumsum(_sizes(b.column(by)))
        low = 0
        while low < b.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, min(low + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield b.slice(low, high - low)
            low = high


class Best:
    """The k best scores a query so far, so that a task's later slices give only rows that may still be among them."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, np.full((queries, k), -np.inf)

    def places(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) places in scores (queries x rows) of what reaches a query's k-th best score yet; ties with it stay."""
        both = np.concatenate([self.held, scores], axis=1)
        both.partition(both.shape[1] - self.k, axis=1)
        self.held = both[:, -self.k :].copy()
        return np.nonzero(scores >= self.held.min(axis=1)[:, None])
