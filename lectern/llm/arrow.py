"""Arrow batches of texts cut by bytes, so that a task holds few texts as Python objects, however long they are."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

BYTES = 4 << 20


def slices(batches, column: str = "text", limit: int = BYTES):
    """Each batch in runs of rows that hold about `limit` bytes of `column`; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        low = 0
        while low < len(ends):
            start = ends[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, start + limit, "right")))
            yield batch.slice(low, high - low)
            low = high
