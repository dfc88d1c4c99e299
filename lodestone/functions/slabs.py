"""Arrow columns of texts in parts of bounded size, so that what a task makes of them doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are worked on at once.
SLAB_BYTES = 1 << 20


def slabs(texts: pa.Array, rows: int | None = None, size: int = SLAB_BYTES) -> Iterator[pa.Array]:
    """The texts in slices of at most `size` bytes and `rows` rows; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        last = min(last, first + rows) if rows else last
        yield texts.slice(first, last - first)
        first = last
