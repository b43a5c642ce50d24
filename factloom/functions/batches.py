"""Arrow batches of texts in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into Python's strings at once; a batch of Arrow's has a number of rows, whatever their size.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts have about SLICE_BYTES; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends, start = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop
