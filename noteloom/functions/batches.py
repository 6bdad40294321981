"""Arrow batches in slices, so that few rows at a time become Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and, by the batch's mean, bytes of a slice at most (a row is never cut). They steer memory, not results.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 21


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    n = len(batch)
    rows = max(1, min(SLICE_ROWS, n * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)
