"""The model as DataFrame plans: fit by mutation, map draws to cells in blocks, reduce, write the output tables.

Cells come to the fits, not fits to the cells: a fit (8 MB a year at the reference size) is dealt once, by mutation and
year; cells go out in slices of bounded size, each broadcast, and a task goes through them block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Box, laea_km
from ..operators import grid as G
from ..operators.quantiles import exact_quantile
from ..shared import stored
from . import fitting, kalman, rff
from .blas import one_thread

SLICE = 1 << 20  # cells that are broadcast at a time


@dataclass(frozen=True)
class Settings:
    """features: D random frequencies; the reference workload is D = 1000, 5 rounds, 500 draws, a grid of 200 x 200."""

    features: int = 200
    rounds: int = 5
    draws: int = 500
    first_year: int = 1995
    last_year: int = 2025
    nx: int = 200
    ny: int = 200
    seed: int = 1
    factor: str = "lower"
    thresholds: tuple[float, ...] = (0.01, 0.05, 0.1)
    block: int = 2048
    years_out: tuple[int, ...] = field(default=())

    @property
    def years(self) -> list[int]:
        return list(range(self.first_year, self.last_year + 1))


def local_km(df: DataFrame, centre: tuple[float, float] | None = None, lon: str = "longitude", lat: str = "latitude") -> tuple[DataFrame, tuple[float, float]]:
    """x_km, y_km around a centre (default: the median position)."""
    if centre is None:
        centre = (exact_quantile(df, lon), exact_quantile(df, lat))
    x, y = laea_km(F.col(lon), F.col(lat), *centre)
    return df.withColumn("x_km", x).withColumn("y_km", y), centre


def fit_models(obs: DataFrame, hyper: DataFrame, s: Settings = Settings(), noise: Callable[[int, int, int], np.ndarray] | None = None) -> DataFrame:
    """(mutation, t, ell_km, weights array<double> by weight and draw): joint posterior draws of the weights of each year.

    obs: mutation, year, x_km, y_km, numerator, denominator; hyper: mutation, ell_km, tau2_year. The fits are stored, dealt by mutation and year.
    noise: the normal numbers of a draw (weights x draws) by year, number of weights and of draws, where they are given from outside.
    """
    years, spark = s.years, obs.sparkSession

    def draws(mutation: str, ell: float, passes: kalman.Passes) -> pd.DataFrame:
        given = noise and (lambda i: noise(years[i], 2 * s.features, s.draws))
        paths = kalman.posterior_paths(passes, s.draws, s.seed + 1, s.factor, given)
        keep = [i for i, y in enumerate(years) if not s.years_out or y in s.years_out]
        return pd.DataFrame({"mutation": mutation, "t": np.array([years[i] for i in keep], np.int32), "ell_km": ell, "weights": [paths[i].ravel() for i in keep]})

    fits = fitting.em(obs, hyper, s.features, s.seed, years, s.rounds, draws, "mutation string, t int, ell_km double, weights array<double>")
    tasks = max(1, 4 * min(hyper.count() * len(s.years_out or years), spark.sparkContext.defaultParallelism))
    return stored(fits, "fits").repartition(tasks, "mutation", "t")


def smoothed(obs: DataFrame, hyper: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(mutation, t, ell_km, loglik, mean array<double>, cov array<double>): smoothed weights and their covariance by row, no draws."""

    def moments(mutation: str, ell: float, passes: kalman.Passes) -> pd.DataFrame:
        mean, cov = kalman.rts_smoother(passes, covariances=True)
        return pd.DataFrame({"mutation": mutation, "t": np.array(s.years, np.int32), "ell_km": ell, "loglik": passes.loglik, "mean": list(mean), "cov": [c.ravel() for c in cov]})

    return stored(fitting.em(obs, hyper, s.features, s.seed, s.years, s.rounds, moments, "mutation string, t int, ell_km double, loglik double, mean array<double>, cov array<double>"), "smoothed")


def _slices(cells: DataFrame) -> Iterator[pd.DataFrame]:
    """All cells, at most SLICE at a time, in the order of their pixels."""
    last = cells.agg(F.max("pixel")).first()[0]
    for k in range(0, 0 if last is None else last + 1, SLICE):
        yield cells.filter(F.col("pixel").between(k, k + SLICE - 1)).select("pixel", "x", "y", "x_km", "y_km", "id_1").toPandas().sort_values("pixel", kind="stable")


def _mapped(fits: DataFrame, cells: DataFrame, s: Settings, reduce, schema: str) -> DataFrame:
    """reduce(row, block of cells, prevalence by cell and draw) for every fit and block of s.block cells."""
    spark = fits.sparkSession

    def one(part: pd.DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one_thread()
            for b in batches:
                for mutation, t, ell, weights in zip(b["mutation"], b["t"], b["ell_km"], b["weights"]):
                    omega = rff.frequencies(s.features, ell, s.seed)
                    beta = np.asarray(weights, float).reshape(2 * s.features, -1)
                    for k in range(0, len(shared.value), s.block):
                        at = shared.value.iloc[k : k + s.block]
                        p = 1 / (1 + np.exp(-(kalman.Z0 + rff.features(at[["x_km", "y_km"]].to_numpy(float), omega) @ beta)))
                        yield pd.DataFrame({"mutation": mutation, "t": t} | reduce(at, p))

        return fits.mapInPandas(run, schema)

    parts = [one(part) for part in _slices(cells)]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def surface(fits: DataFrame, cells: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(mutation, t, pixel, x, y, mean, median, ci_width, ex_*): one product a year and block, reduced where it is made.

    The draws of all cells and years are never stored; a block holds block x draws doubles.
    """
    names = [f"ex_{round(100 * t)}" for t in s.thresholds]

    def reduce(at: pd.DataFrame, p: np.ndarray) -> dict:
        q = np.quantile(p, [0.025, 0.5, 0.975], axis=1)
        out = {"pixel": at["pixel"].to_numpy(), "x": at["x"].to_numpy(), "y": at["y"].to_numpy(), "mean": p.mean(1), "median": q[1], "ci_width": q[2] - q[0]}
        return out | {n: (p > t).mean(1) for n, t in zip(names, s.thresholds)}

    return _mapped(fits, cells, s, reduce, "mutation string, t int, pixel long, x double, y double, mean double, median double, ci_width double, " + ", ".join(f"{n} double" for n in names))


def region_draws(fits: DataFrame, cells: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(mutation, id_1, t, draw, mean_p): sums and counts by block, combined by a grouped sum."""

    def reduce(at: pd.DataFrame, p: np.ndarray) -> dict:
        regions, index = np.unique(at["id_1"].to_numpy(str), return_inverse=True)
        order = np.argsort(index, kind="stable")
        n = np.bincount(index)
        sums = np.add.reduceat(p[order], np.cumsum(n) - n, axis=0)
        draws = p.shape[1]
        return {"id_1": np.repeat(regions, draws), "draw": np.tile(np.arange(1, draws + 1), len(regions)), "s": sums.ravel(), "n": np.repeat(n, draws)}

    parts = _mapped(fits, cells.filter("id_1 IS NOT NULL"), s, reduce, "mutation string, t int, id_1 string, draw int, s double, n long")
    return parts.groupBy("mutation", "id_1", "t", "draw").agg((F.sum("s") / F.sum("n")).alias("mean_p"))


def pointwise(means: DataFrame, cells: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(mutation, t, pixel, x, y, mean_z, low, high) from smoothed means and covariances (smoothed()), without draws."""
    spark = means.sparkSession
    schema = "mutation string, t int, pixel long, x double, y double, mean_z double, low double, high double"

    def one(part: pd.DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one_thread()
            for b in batches:
                for mutation, t, ell, mean, cov in zip(b["mutation"], b["t"], b["ell_km"], b["mean"], b["cov"]):
                    omega, mean = rff.frequencies(s.features, ell, s.seed), np.asarray(mean, float)
                    for k in range(0, len(shared.value), s.block):
                        at = shared.value.iloc[k : k + s.block]
                        phi = rff.features(at[["x_km", "y_km"]].to_numpy(float), omega)
                        band = kalman.pointwise_interval(phi, mean, np.asarray(cov, float).reshape(len(mean), -1))
                        yield pd.DataFrame({"mutation": mutation, "t": t, "pixel": at["pixel"].to_numpy(), "x": at["x"].to_numpy(), "y": at["y"].to_numpy(), "mean_z": kalman.Z0 + phi @ mean, "low": band[:, 0], "high": band[:, 1]})

        return means.mapInPandas(run, schema)

    parts = [one(part) for part in _slices(cells)]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prediction_cells(spark: SparkSession, box: Box, s: Settings, centre: tuple[float, float]) -> DataFrame:
    """pixel, x, y, x_km, y_km of a grid, with id_1 NULL until a spatial join gives it."""
    cells, _ = local_km(G.grid(spark, box, s.nx, s.ny), centre, "x", "y")
    return cells.withColumn("id_1", F.lit(None).cast("string"))
