"""Tables of vectors as packed numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty, nor with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a binary column of doubles."""
    return [np.frombuffer(x.as_buffer(), dtype="<f8") for x in column]


def block(column: pa.Array) -> np.ndarray:
    """A matrix of a binary column whose rows have one length."""
    rows = rows_of(column)
    return np.stack(rows) if rows else np.zeros((0, 0))


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, dtype="<f8")], pa.binary())
