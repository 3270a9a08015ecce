"""Simulation of space-time fields by their spectrum, and surveys drawn from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import buffer_vector
from ..operators.report import sample_rows

KINDS = ("RBF", "Exp")


def _kernel(d: np.ndarray, length: float, kind: str) -> np.ndarray:
    if kind not in KINDS:
        raise ValueError(f"kernel must be one of {KINDS}, not {kind!r}")
    return np.exp(-(d**2) / (2 * length**2)) if kind == "RBF" else np.exp(-d / length)


def sim_array(x, y, t, length_space: float, length_time: float, noise: np.ndarray | None = None, mu: float = 0.0, sill: float = 1.0,
              buffers: tuple[int, int, int] = (10, 10, 10), space: str = "RBF", time: str = "RBF", seed: int = 1, signed_time: bool = False) -> np.ndarray:
    """A field on the axes x, y, t: white noise filtered by the root of the kernel's spectrum on a buffered, periodic grid.

    noise: standard normal values on the buffered grid, else drawn from the seed. signed_time: an exponential time kernel
    without absolute lags, which grows to one side; there for comparison.
    """
    ax = [np.array(buffer_vector(list(map(float, v)), n)) for v, n in zip((x, y, t), buffers)]
    mid = [(a[0] + a[-1]) / 2 for a in ax]
    dx, dy, dt = np.meshgrid(*(a - m for a, m in zip(ax, mid)), indexing="ij")
    k = _kernel(np.sqrt(dx**2 + dy**2), length_space, space) * _kernel(dt if signed_time and time == "Exp" else np.abs(dt), length_time, time)
    w = np.random.default_rng(seed).normal(size=k.shape) if noise is None else noise
    field = np.real(np.fft.ifftn(np.sqrt(np.fft.fftn(k)) * np.fft.fftn(w)))
    cut = tuple(slice(n, len(a) - n) for a, n in zip(ax, buffers))
    return np.sqrt(sill) * field[cut] + mu


def sim_field(spark: SparkSession, x, y, t, seeds: list[int], **settings) -> DataFrame:
    """(seed, x, y, t, z): a field for each seed, each in a task of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seed in b["seed"]:
                a = sim_array(x, y, t, seed=int(seed), **settings)
                i, j, k = np.meshgrid(range(len(x)), range(len(y)), range(len(t)), indexing="ij")
                yield pd.DataFrame({"seed": int(seed), "x": np.asarray(x, float)[i.ravel()], "y": np.asarray(y, float)[j.ravel()], "t": np.asarray(t, float)[k.ravel()], "z": a.ravel()})

    return spark.createDataFrame([(s,) for s in seeds], "seed int").repartition(len(seeds), "seed").mapInPandas(run, "seed int, x double, y double, t double, z double")


def draw_surveys(field: DataFrame, n: int, samples: int, seed: int = 1) -> DataFrame:
    """n cells without replacement with p, N, k ~ Binomial(N, p), p_est and p_emplogit; the same for the same seed."""
    cells = sample_rows(field.select("x", "y", "t", "z"), n, seed, ["x", "y", "t", "z"]).withColumn("p", X.plogis(F.col("z"))).withColumn("h", F.xxhash64(F.lit(seed), "x", "y", "t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = [np.random.default_rng(abs(int(h))).binomial(samples, p) for h, p in zip(b["h"], b["p"])]
            yield b.drop(columns="h").assign(N=float(samples), k=np.array(k, float))

    out = cells.mapInPandas(run, "x double, y double, t double, z double, p double, N double, k double")
    return out.withColumn("p_est", F.col("k") / F.col("N")).withColumn("p_emplogit", X.emplogit(F.col("k"), F.col("N")))
