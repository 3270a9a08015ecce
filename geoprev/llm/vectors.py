"""Vector columns in Arrow batches as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lengths(df: DataFrame, vec_col: str) -> list[int]:
    """The lengths of vectors, the commonest first (of equally common ones the longest); empty and null vectors aside."""
    size = F.size(F.col(f"`{vec_col}`"))
    counts = df.select(size.alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1025).collect()
    if len(counts) > 1024:
        raise ValueError("vectors of more than 1024 different lengths")
    return [r["d"] for r in counts]


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold d finite numbers, and these as float64."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    row = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False) & (np.diff(offsets) == d))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(row) and (np.diff(row) == 1).all():
        x = values[offsets[row[0]] : offsets[row[-1]] + d].reshape(-1, d)
    else:
        x = values[offsets[row][:, None] + np.arange(d)]
    ok = np.isfinite(x).all(1)
    return (row, x) if ok.all() else (row[ok], x[ok])
