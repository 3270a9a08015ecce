"""The filter as a stream with its covariance in blocks: a micro-batch reads and writes the state of the mutations that it has.

State by mutation (transformWithState, RocksDB): the last year and the mean as one value, the covariance as a map of blocks of rows. Years
come in order; a year's surveys come in one micro-batch. Surveys of a year that the state has passed change nothing: they go to a side
output, which `advanced` and `late` tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import kalman, rff

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "mutation string, year int, late boolean, n_surveys long, m array<double>, spread array<double>"


def one_year(m: np.ndarray, c: np.ndarray, years: int, places: pd.DataFrame, omega: np.ndarray, tau2: float) -> tuple[np.ndarray, np.ndarray]:
    """Predict over some years, then take in one year's surveys with weights at the predicted mean."""
    places = places.groupby(["x_km", "y_km"], as_index=False)[["numerator", "denominator"]].sum()
    phi = rff.features(places[["x_km", "y_km"]].to_numpy(float), omega)
    w, z = kalman.pseudo(phi, places["numerator"].to_numpy(float), places["denominator"].to_numpy(float), m)
    c = c + years * tau2 * np.eye(len(m))
    said = kalman.said_by(phi, z, w)
    m, c, _ = kalman.update_sums(m, c, said) if isinstance(said, kalman.Information) else kalman.update_rows(m, c, *said)
    return m, (c + c.T) / 2


def _usable(d: pd.DataFrame) -> pd.DataFrame:
    ok = np.isfinite(d["numerator"].to_numpy(float)) & np.isfinite(d["denominator"].to_numpy(float)) & (d["denominator"].to_numpy(float) > 0)
    return d[ok & d[["x_km", "y_km"]].notna().all(axis=1).to_numpy()]


class Filter(StatefulProcessor):
    def __init__(self, features: int, ell_km: float, tau2: float, start_year: int, seed: int = 1, block: int = 256):
        self.features, self.ell_km, self.tau2, self.start_year, self.seed, self.block = features, ell_km, tau2, start_year, seed, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "year int, m binary")
        self.rows = handle.getMapState("covariance", "block int", "v binary")
        self.omega = rff.frequencies(self.features, self.ell_km, self.seed)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        d, size = _usable(pd.concat(list(rows))), 2 * self.features
        year, m, c = self.start_year, np.zeros(size), np.zeros((size, size))
        if self.head.exists():
            year, mean = self.head.get()
            m = np.frombuffer(mean).copy()
            for k in range(0, size, self.block):
                c[k : k + self.block] = np.frombuffer(self.rows.getValue((k // self.block,))[0]).reshape(-1, size)
        out, was = [], year
        for y, g in d.groupby("year"):
            if y <= was:
                out.append((key[0], int(y), True, len(g), None, None))
                continue
            m, c = one_year(m, c, int(y) - year, g, self.omega, self.tau2)
            year = int(y)
            out.append((key[0], year, False, len(g), m.copy(), np.diag(c).copy()))
        if year > was:
            self.head.update((year, m.tobytes()))
            for k in range(0, size, self.block):
                self.rows.updateValue((k // self.block,), (c[k : k + self.block].tobytes(),))
        if out:
            yield pd.DataFrame(out, columns=["mutation", "year", "late", "n_surveys", "m", "spread"])

    def close(self) -> None:
        pass


def filtered(surveys: DataFrame, features: int, ell_km: float, tau2: float, start_year: int, seed: int = 1, block: int = 256) -> DataFrame:
    """A row for each mutation and year that a micro-batch brings: m and the diagonal of the covariance, or late surveys of a year passed.

    surveys: a stream of mutation, year, x_km, y_km, numerator, denominator. The session's state store has to be RocksDB (`PROVIDER`).
    """
    return surveys.groupBy("mutation").transformWithStateInPandas(Filter(features, ell_km, tau2, start_year, seed, block), OUT, "Update", "None")


def advanced(out: DataFrame) -> DataFrame:
    return out.filter("NOT late").drop("late")


def late(out: DataFrame) -> DataFrame:
    return out.filter(F.col("late")).select("mutation", "year", "n_surveys")


def filter_batch(places: pd.DataFrame, features: int, ell_km: float, tau2: float, start_year: int, seed: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The same for all surveys of one mutation at once, by year."""
    omega, m, c, year, out = rff.frequencies(features, ell_km, seed), np.zeros(2 * features), np.zeros((2 * features, 2 * features)), start_year, {}
    for y, g in _usable(places).groupby("year"):
        m, c = one_year(m, c, int(y) - year, g, omega, tau2)
        year, out[int(y)] = int(y), (m, c)
    return out
