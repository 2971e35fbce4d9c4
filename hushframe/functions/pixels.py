"""Pixels of unions of boxes, for all pages of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of a slab and a box in it that are held at once; one slab is never parted.
PAIRS = 1 << 20


def flattened(boxes: pa.Array, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and x1, y1, x2, y2 of each box of a list array, clipped to the page; null coordinates are 0."""
    flat = boxes.flatten()
    rows = np.repeat(np.arange(len(boxes)), boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sides = [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten()]
    by_name = dict(zip([f.name for f in flat.type], sides))
    return rows, np.stack([by_name[k].clip(0, most) for k, most in (("x1", width), ("y1", height), ("x2", width), ("y2", height))])


def union_areas(n_rows: int, rows: np.ndarray, boxes: np.ndarray, width: int, height: int, pairs: int = PAIRS) -> np.ndarray:
    """By row the pixels in any of its boxes, exactly: slabs between its vertical edges, in each of which the boxes that
    cross it are walked from the top down. A box crosses slabs that follow each other, so that no others are looked at.
    """
    out = np.zeros(n_rows, np.int64)
    full = (boxes[0] < boxes[2]) & (boxes[1] < boxes[3])
    order = np.lexsort((boxes[1][full], rows[full]))
    row, (x1, y1, x2, y2) = rows[full][order], boxes[:, full][:, order]
    if not len(row):
        return out
    edges, at = np.unique(np.concatenate([row * (width + 1) + x1, row * (width + 1) + x2]), return_inverse=True)
    first, end = at[: len(row)], at[len(row) :]
    starts = np.bincount(first, minlength=len(edges)) - np.bincount(end, minlength=len(edges))
    total = np.concatenate([[0], np.cumsum(np.cumsum(starts))])
    lo = 0
    while lo < len(edges):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + pairs, "right")) - 1)
        begin, stop = np.maximum(first, lo), np.minimum(end, hi)
        box = np.flatnonzero(begin < stop)
        n = (stop - begin)[box]
        slab = np.repeat(begin[box] - np.cumsum(n) + n, n) + np.arange(n.sum())
        down = np.argsort(slab, kind="stable")
        slab, box = slab[down], np.repeat(box, n)[down]
        # The lowest end so far, from the beginning of each slab: ends of earlier slabs count as above the page.
        upto = np.maximum.accumulate(y2[box] + slab * (height + 1)) - slab * (height + 1)
        upto = np.concatenate([[0], upto[:-1] - (np.diff(slab) * (height + 1))]) if len(slab) else upto
        gained = np.maximum(0, y2[box] - np.maximum(y1[box], upto)) * (edges[np.minimum(slab + 1, len(edges) - 1)] - edges[slab])
        np.add.at(out, row[box], gained)
        lo = hi
    return out


def union_pixels(masks: Column, sensitive: Column, width: int, height: int) -> Column:
    """struct<mask_px, sensitive_px, either_px> of two arrays of boxes; null where the arrays are."""

    @F.arrow_udf("mask_px bigint, sensitive_px bigint, either_px bigint")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            (rows_a, boxes_a), (rows_b, boxes_b) = flattened(a, width, height), flattened(b, width, height)
            of = lambda rows, boxes: union_areas(len(a), rows, boxes, width, height)  # noqa: B023, E731
            either = of(np.concatenate([rows_a, rows_b]), np.concatenate([boxes_a, boxes_b], axis=1))
            no_a, no_b = (x.is_null().to_numpy(zero_copy_only=False) for x in (a, b))
            px = ((of(rows_a, boxes_a), no_a), (of(rows_b, boxes_b), no_b), (either, no_a | no_b))
            yield pa.StructArray.from_arrays([pa.array(v, mask=none) for v, none in px], ["mask_px", "sensitive_px", "either_px"])

    return count.asNondeterministic()(masks, sensitive)
