"""Arrow helpers for vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Vectors of another length, null vectors and all-zero vectors take no part in any search.
DIMENSION = 64


def unit_rows(column: pa.Array, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors float32) of the usable rows of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    rows = np.flatnonzero(lengths == dimension)
    if not len(rows):
        return rows, np.empty((0, dimension), np.float32)
    values = pa.compute.fill_null(column.take(pa.array(rows)).flatten(), float("nan"))
    x = np.asarray(values, np.float32).reshape(-1, dimension)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    usable = np.isfinite(norm) & (norm > 0)
    return rows[usable], (x[usable] / norm[usable, None]).astype(np.float32)


def sample_units(rows: list, dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of collected rows."""
    return unit_rows(pa.array([list(r) for r in rows], pa.list_(pa.float32())), dimension)[1]
