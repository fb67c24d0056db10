"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 1 << 18  # words that a Python task works on at once: arrays of some 2 MB each


def word_pieces(batch: pa.RecordBatch, lists: str, most: int = MOST_WORDS) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose lists in column ``lists`` hold about ``most`` values together, at least one row each."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(i, j - i)
        i = j
