"""Moments of pairs of columns, as a task adds them up from its batches of rows. Its functions travel to the executors by
value, so these need no copy of the package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Of the rows where both are present: their number, the means less each column's base, squares and products about the
#: means, and ends. A base is a value among the column's, so that means far from zero keep their digits.
MOMENTS = ("n", "x", "y", "xx", "yy", "xy", "x0", "x1", "y0", "y1")
SCHEMA = f"i int, j int, base_x double, base_y double, {', '.join(f'{m} double' for m in MOMENTS)}"


#: Rows of a batch, evenly spread, that are looked at first to see which columns vary.
FEW = 256


def _ends(value: np.ndarray, there: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per column the least and greatest of its values in rows, or of a few of these where they vary already."""

    def of(value: np.ndarray, there: np.ndarray, rows: np.ndarray) -> np.ndarray:
        value, there = np.compress(rows, value, axis=1), np.compress(rows, there, axis=1)
        return np.stack([value.min(axis=1, initial=np.inf, where=there), value.max(axis=1, initial=-np.inf, where=there)])

    step = max(1, len(rows) // FEW)
    ends = of(value[:, ::step], there[:, ::step], rows[::step])
    same = np.flatnonzero(~(ends[0] < ends[1]))
    if step > 1 and len(same):
        ends[:, same] = of(value[same], there[same], rows)
    return ends


def of_batch(values: pa.ListArray, left: np.ndarray, right: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of each left by each right place of values, which hold a number or none for every place, as matrices. Absent
    values and ones that aren't finite count as zeros of a product of matrices; a pair with one of the latter gets no
    number as xy. base: by place; it is set here for columns that have their first values.

    What a column adds up to beside another depends on the other's absent rows only, so it is made once for all columns
    that are absent in the same rows."""
    flat = values.flatten()
    by_place = lambda a: np.array(a.to_numpy(zero_copy_only=False).reshape(len(values), -1).T, order="C")
    there, value = by_place(flat.is_valid()), by_place(flat.fill_null(0.0))
    odd = ~np.isfinite(value)
    value[odd] = 0.0
    known: dict[bytes, int] = {}
    mask = np.array([known.setdefault(row.tobytes(), len(known)) for row in np.packbits(there, axis=1)])
    rows = there[np.unique(mask, return_index=True)[1]]
    ends = np.stack([_ends(value, there, m) for m in rows], axis=2)
    weight = rows.astype(float)
    centre = value.sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    base[:] = np.where(np.isnan(base) & there.any(axis=1), centre, base)
    mean = np.where(np.isnan(base), 0.0, centre - base)
    about = np.subtract(value, centre[:, None], out=value)
    about *= there
    total, square, both = about @ weight.T, (about * about) @ weight.T, weight @ weight.T
    at, of_left, of_right = np.ix_(left, mask[right]), np.ix_(mask[left], mask[right]), np.ix_(right, mask[left])
    n, sx, sy = both[of_left], total[at], total[of_right].T
    some = np.maximum(n, 1.0)
    xy = about[left] @ about[right].T - sx * sy / some
    if odd.any():
        strange = odd @ weight.T
        xy[(strange[at] > 0) | (strange[of_right].T > 0)] = np.nan
    return {
        "n": n, "x": mean[left][:, None] + sx / some, "y": mean[right][None, :] + sy / some,
        "xx": square[at] - sx * sx / some, "yy": square[of_right].T - sy * sy / some, "xy": xy,
        "x0": ends[0][at], "x1": ends[1][at], "y0": ends[0][of_right].T, "y1": ends[1][of_right].T,
    }


def together(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of the rows of a and of b, without a difference of great sums."""
    n = a["n"] + b["n"]
    share = b["n"] / np.maximum(n, 1.0)
    dx, dy, w = b["x"] - a["x"], b["y"] - a["y"], a["n"] * share
    return {
        "n": n, "x": a["x"] + dx * share, "y": a["y"] + dy * share,
        "xx": a["xx"] + b["xx"] + dx * dx * w, "yy": a["yy"] + b["yy"] + dy * dy * w, "xy": a["xy"] + b["xy"] + dx * dy * w,
        **{m: np.minimum(a[m], b[m]) for m in ("x0", "y0")}, **{m: np.maximum(a[m], b[m]) for m in ("x1", "y1")},
    }


def moments(left: list[int], right: list[int], half: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over batches of a column of arrays of doubles: one row per pair of places i in left and j in right. half: i <= j only."""
    xs, ys = np.array(left), np.array(right)
    i, j = (k.ravel() for k in np.indices((len(left), len(right))))
    kept = i <= j if half else i >= 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = None, np.full(1 + max(*left, *right), np.nan)
        for batch in batches:
            if batch.num_rows:
                new = of_batch(batch.column(0), xs, ys, base)
                found = new if found is None else together(found, new)
        if found is not None:
            base = np.nan_to_num(base)
            rows = {"i": i.astype("int32"), "j": j.astype("int32"), "base_x": base[xs][i], "base_y": base[ys][j], **{m: found[m].ravel() for m in MOMENTS}}
            yield pa.RecordBatch.from_pydict({name: pa.array(row[kept]) for name, row in rows.items()})

    return task
