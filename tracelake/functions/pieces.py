"""Pieces of overlapping ranges, bin by bin, on Arrow batches inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About so many ids go into a batch that is given back; a piece's own ids are never parted.
IDS = 1 << 19


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike."""
    a, b = column[1:], column[:-1]
    return pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first begins another group: by the first two columns."""
    return _changes(rows.column(0)) | _changes(rows.column(1))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut only where a group ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = rest[-1].slice(rest[-1].num_rows - 1) if rest else batch.slice(0, 1)
        begins = np.flatnonzero(_begins(pa.concat_batches([last, batch])))
        if len(begins):
            done = [*rest, batch.slice(0, begins[-1])]
            rest = [batch.slice(begins[-1])]
            if any(b.num_rows for b in done):
                yield pa.concat_batches(done)
        else:
            rest.append(batch)
    if rest:
        yield pa.concat_batches(rest)


def _cut(rows: pa.RecordBatch, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    key, place, ident, start, end, after = rows.columns
    group = np.concatenate(([0], np.cumsum(_begins(rows))))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    base = place.to_numpy()[first] * width
    ends = np.zeros(len(first), np.int64)  # where the last piece of a group ends
    told = np.flatnonzero(after.is_valid().to_numpy(zero_copy_only=False))
    ends[group[told]] = after.take(pa.array(told)).to_numpy()

    own = np.flatnonzero(start.is_valid().to_numpy(zero_copy_only=False))
    g = group[own]
    low, high = (c.take(pa.array(own)).to_numpy() - base[g] for c in (start, end))
    # Positions of all groups in one row of numbers: those of a group are its number times the width and more.
    left, right = (g * width + np.clip(x, 0, width) for x in (low, high))
    cuts = np.sort(np.concatenate((left[low >= 0], right[high < width])))
    if not len(cuts):
        return
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
    of = cuts // width
    begin = cuts - of * width + base[of]
    until = np.append(begin[1:], 0)
    closing = np.append(of[1:] != of[:-1], True)
    until[closing] = ends[of[closing]]
    lo, hi = np.searchsorted(cuts, left), np.searchsorted(cuts, right)
    depth = np.cumsum(np.bincount(lo, minlength=len(cuts) + 1) - np.bincount(hi, minlength=len(cuts) + 1))[:-1]
    total = np.cumsum(depth)
    number = np.concatenate(([0], np.cumsum(_changes(ident))))[own]  # equal ids follow each other
    null = ident.is_null().to_numpy(zero_copy_only=False)[own]
    plain = not null.any() and bool((np.diff(number) > 0).all())

    p = 0
    while p < len(cuts):
        q = int(np.searchsorted(total, (total[p - 1] if p else 0) + IDS, "right"))
        q = min(max(q, p + 1), p + 0xFFFF, len(cuts))
        met = np.flatnonzero((lo < q) & (hi > p) & (lo < hi))
        a, b = np.maximum(lo[met], p) - p, np.minimum(hi[met], q) - p
        n = b - a
        piece = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a, n)).astype(np.uint16)
        order = np.argsort(piece, kind="stable")  # keeps the order of ids within a piece
        row, piece = np.repeat(met, n)[order], piece[order]
        if not plain:
            keep = ~null[row]
            keep[1:] &= (piece[1:] != piece[:-1]) | (number[row[1:]] != number[row[:-1]])
            row, piece = row[keep], piece[keep]
        covered = np.flatnonzero(depth[p:q])
        if len(covered):
            offsets = np.concatenate(([0], np.cumsum(np.bincount(piece, minlength=q - p)[covered]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), ident.take(pa.array(own[row])))
            at = covered + p
            yield pa.RecordBatch.from_arrays([key.take(pa.array(first[of[at]])), pa.array(begin[at]), pa.array(until[at]), ids], names=names)
        p = q


def pieces(width: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows of a key, the number of a bin, id, start, end, next, in order of the first three, to pieces
    ``key, start, end, ids`` (columns ``names``): each from an end of a range in the bin to the next end, if a range covers it.

    The next end behind a bin's last one stands in a row without start. Ranges of a bin are at hand together, and about ``IDS`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            yield from _cut(rows, width, names)

    return run
