"""Arrow batches cut by their bytes, so that a few large cells do not lie in memory together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def byte_slices(batch: pa.RecordBatch, *columns: int, most_bytes: int = 8 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary columns hold about ``most_bytes`` together (one row at least)."""
    sizes = [sum(len(batch.column(c)[i].as_buffer()) if batch.column(c)[i].is_valid else 0 for c in columns) for i in range(batch.num_rows)]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
