"""Whole-number vectors in blocks, as the vector operators use them.

A component ``x`` becomes ``floor(scale * x)``, with ``x`` as a double. Vectors that
are null or have a null or non-finite component take no part. Results beyond
``LARGEST`` count as that bound, so that products of any two vectors stay whole
numbers of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LARGEST = 2**26


def whole_vectors(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part (with ``width`` components, if given), and their vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    values = column.values
    plain = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(plain))])
    sizes = np.diff(ends)
    good = (bad[ends[1:]] == bad[ends[:-1]]) & ~np.asarray(column.is_null())
    if width is not None:
        good &= sizes == width
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(scale * np.where(np.isfinite(plain), plain, 0.0)), -LARGEST, LARGEST).astype(np.int32)
    rows = np.flatnonzero(good)
    return rows, [scaled[ends[k] : ends[k + 1]] for k in rows]


def stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """One row per vector; missing components at the end are 0."""
    out = np.zeros((len(vectors), width), np.int32)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exact.

    In doubles where all partial sums are whole numbers that these hold.
    """
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
