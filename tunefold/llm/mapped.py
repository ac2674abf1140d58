"""Arrow batches in runs of bounded size."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes, so that what is made from one run stays small."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
