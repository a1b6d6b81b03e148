"""Arrow batches cut by the bytes of one column."""

from __future__ import annotations

from collections.abc import Iterator

#: A task holds about this many bytes of text at a time, however many rows a batch has.
BYTES = 4_000_000


def by_bytes(batches: Iterator, column: str, most: int = BYTES) -> Iterator:
    """The batches in pieces of about `most` bytes of a string or binary column; one longer value stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        part = np.cumsum(sizes + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
