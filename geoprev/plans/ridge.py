"""Ridge regression with cross-validated penalty from one pass over the rows.

The pass sums X'X, X'y, y'y and n by fold, in tasks first and then by a second round of tasks. What a fold leaves is all sums less
its own, so no row is read again: an eigendecomposition a fold serves all penalties, and the error on the fold is a form in its sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_batches

SUMS = "fold int, xx binary, xy binary, yy double, n long"


@dataclass
class Sums:
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.xx + o.xx, self.xy + o.xy, self.yy + o.yy, self.n + o.n)

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.xx - o.xx, self.xy - o.xy, self.yy - o.yy, self.n - o.n)


def _row(fold: int, s: Sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([s.xx.tobytes()], pa.binary()), pa.array([s.xy.tobytes()], pa.binary()), pa.array([s.yy]), pa.array([s.n])], names=["fold", "xx", "xy", "yy", "n"])


def _read(r) -> Sums:
    xy = np.frombuffer(r["xy"])
    return Sums(np.frombuffer(r["xx"]).reshape(len(xy), -1), xy, r["yy"], r["n"])


def fold_sums(rows: DataFrame, x: Column, y: Column, fold: Column, p: int, adders: int = 32) -> dict[int, Sums]:
    """Sums of each fold; x: array of p numbers. Rows with a NULL, NaN or infinite number are left out."""
    small_batches(rows.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, Sums] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, p)
            t, of = b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("fold").to_numpy()
            ok = np.isfinite(v).all(1) & np.isfinite(t)
            for f in np.unique(of[ok]).tolist():
                own = ok & (of == f)
                a, c = v[own], t[own]
                total[f] = total.get(f, Sums(np.zeros((p, p)), np.zeros(p), 0.0, 0)) + Sums(a.T @ a, a.T @ c, float(c @ c), len(c))
        for f, s in total.items():
            made = _row(f, s)
            yield made.append_column("task", pa.array([TaskContext.get().partitionId()], pa.int32()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Sums] = {}
        for b in batches:
            for r in b.to_pylist():
                total[r["fold"]] = total[r["fold"]] + _read(r) if r["fold"] in total else _read(r)
        for f, s in total.items():
            yield _row(f, s)

    given = rows.select(x.alias("x"), y.cast("double").alias("y"), fold.cast("int").alias("fold")).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.size("x") == p))
    parts = given.mapInArrow(part, SUMS + ", task int").repartition(adders, "fold", F.col("task") % 4).sortWithinPartitions("fold", "task").drop("task").mapInArrow(add, SUMS)
    out: dict[int, Sums] = {}
    for r in parts.collect():  # a few for each fold
        out[r["fold"]] = out[r["fold"]] + _read(r) if r["fold"] in out else _read(r)
    return dict(sorted(out.items()))


PENALTIES = np.logspace(-5, 5, 100)


def path(s: Sums, penalties: np.ndarray = PENALTIES) -> np.ndarray:
    """Weights (p x penalties): (X'X + penalty I)^-1 X'y for every penalty, by one eigendecomposition."""
    e, v = np.linalg.eigh(s.xx)
    return v @ ((v.T @ s.xy)[:, None] / (np.maximum(e, 0)[:, None] + penalties))


def cross_validated(folds: dict[int, Sums], penalties: np.ndarray = PENALTIES) -> tuple[np.ndarray, float, np.ndarray]:
    """Mean squared error of each penalty over held-out folds, the best penalty (the largest of equals), and its weights on all rows."""
    every = sum(folds.values(), Sums(0.0, 0.0, 0.0, 0))
    errors = np.zeros(len(penalties))
    for own in folds.values():
        w = path(every - own, penalties)
        errors += own.yy - 2 * own.xy @ w + (w * (own.xx @ w)).sum(0)
    errors /= every.n
    best = len(errors) - 1 - int(np.argmin(errors[::-1]))
    return errors, float(penalties[best]), path(every, penalties[best : best + 1])[:, 0]
