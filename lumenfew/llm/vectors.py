"""Vectors of a table as matrices: bounded batches of rows, padded to one width."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether a vector is there and has neither a null nor a non-finite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def width(df: DataFrame, column: str) -> int:
    """Components of the longest vector."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros, longer ones are an error."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == wide).all():
        return values.reshape(len(sizes), wide)
    if sizes.max(initial=0) > wide:
        raise ValueError("a vector is longer than the width it was measured at")
    out = np.zeros((len(sizes), wide))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def groups(batches, rows: int):
    """Arrow batches joined or cut to lists of pieces of ``rows`` rows together (the last of fewer)."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield held
                held, n = [], 0
    if held:
        yield held


def row_limit(wide: int, most: int, size: int) -> int:
    """Rows of ``wide`` doubles in ``size`` bytes: one to ``most``."""
    return max(1, min(most, size // (8 * max(wide, 1))))
