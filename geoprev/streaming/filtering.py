"""Filtering as a stream: yearly batches of surveys update each mutation's state with the Kalman step.

State by mutation: mean and covariance of the weights and the last year. A row comes out for each mutation and year that a
micro-batch advances. Smoothing needs later years and stays a batch operator. Years must arrive in order; a year that
is older than the state is counted as late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import kalman, rff

OUT = "mutation string, year int, n_surveys long, late long, mean_logit double, state_norm double"
STATE = "year int, m array<double>, c array<double>"


def step(m: np.ndarray, c: np.ndarray, years: int, phi: np.ndarray, y: np.ndarray, n: np.ndarray, tau2: float) -> tuple[np.ndarray, np.ndarray]:
    """Predict over some years, then take in one year's surveys with weights at the predicted mean."""
    c = c + years * tau2 * np.eye(len(m))
    w = kalman.pg_weights(n, kalman.Z0 + phi @ m)
    target = (y - n / 2) / w - kalman.Z0
    pc = phi @ c
    s = pc @ phi.T + np.diag(1 / w) + kalman.JITTER * np.eye(len(y))
    k = np.linalg.solve(s, pc).T
    c = c - k @ pc
    return m + k @ (target - phi @ m), (c + c.T) / 2


def filter_stream(surveys: DataFrame, ell_km: float, tau2: float, features: int = 50, seed: int = 1, start_year: int = 1994) -> DataFrame:
    """surveys: mutation, year, x_km, y_km, numerator, denominator, as a stream or a batch."""
    omega = rff.frequencies(features, ell_km, seed)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            year, m, c = state.get
            m, c = np.array(m), np.array(c).reshape(len(m), -1)
        else:
            year, m, c = start_year, np.zeros(2 * features), np.zeros((2 * features, 2 * features))
        d = pd.concat(list(frames))
        late = int((d["year"] <= year).sum())
        rows = []
        for y, g in d[d["year"] > year].sort_values(["year", "x_km", "y_km", "numerator"]).groupby("year"):
            phi = rff.features(g[["x_km", "y_km"]].to_numpy(float), omega)
            m, c = step(m, c, int(y) - year, phi, g["numerator"].to_numpy(float), g["denominator"].to_numpy(float), tau2)
            year = int(y)
            rows.append((key[0], year, len(g), late, float((kalman.Z0 + phi @ m).mean()), float(np.linalg.norm(m))))
        state.update((year, m.tolist(), c.ravel().tolist()))
        yield pd.DataFrame(rows or [(key[0], year, 0, late, None, float(np.linalg.norm(m)))], columns=["mutation", "year", "n_surveys", "late", "mean_logit", "state_norm"])

    return surveys.groupBy("mutation").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
