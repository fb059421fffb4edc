"""Arrow batches in small parts, for helpers that make Python objects of their rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a part, about.
PART = 1 << 20


def parts(batches: Iterable[pa.RecordBatch], most: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of ``most`` bytes or so, one row at least.

    Spark fills a batch up to 10,000 rows or 64 MB. Rows as Python objects take several times their bytes, so what a worker holds of
    them at once is bounded here, however many rows a task has; no row is left out and their order stays.
    """
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
