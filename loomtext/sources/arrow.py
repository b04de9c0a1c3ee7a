"""Arrow batches of bounded size."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterator[pa.RecordBatch], column: str | int | Callable, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds much over `limit` bytes of text, binary or lists (8 an element) in `column` (one row at least). column: a
    name or number, or a function of the batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = column(batch) if callable(column) else batch.column(column)
        lists = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
        size = pc.fill_null(pc.list_value_length(values) if lists else pc.binary_length(values), 0).to_numpy(zero_copy_only=False) * (8 if lists else 1)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < n:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
