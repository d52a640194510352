"""Arrow batches in slices of bounded size: Spark limits a batch by its rows alone, whatever their texts hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What Python turns into objects at a time: bytes of texts.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order: in each slice the texts (or bytes) of ``column`` hold less than ``size``, or it is
    one row."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while True:
        end = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + size)))
        yield batch.slice(first, end - first)
        if end >= batch.num_rows:
            return
        first = end
