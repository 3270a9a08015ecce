"""Hyper-parameters: a Gaussian variogram fitted to one-year pairs, and tau squared.

Only the bins (a few hundred rows by construction) come to the driver.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import pairs as P
from ..schema import HYPERPARAMETERS

NUGGET = 0.8


def nelder_mead(f, start, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Minimum of f by a simplex that reflects, expands, contracts and shrinks."""
    start = np.asarray(start, float)
    simplex = [start] + [start + np.eye(len(start))[i] * (0.1 * abs(start[i]) or 0.1) for i in range(len(start))]
    points = sorted(((f(x), tuple(x)) for x in simplex))
    for _ in range(rounds):
        if abs(points[-1][0] - points[0][0]) <= tolerance * (abs(points[0][0]) + tolerance):
            break
        middle = np.mean([x for _, x in points[:-1]], axis=0)
        worst = np.array(points[-1][1])
        at = lambda k: (f(middle + k * (middle - worst)), tuple(middle + k * (middle - worst)))
        new = at(1.0)
        if new[0] < points[0][0]:
            new = min(new, at(2.0))
        elif new[0] >= points[-2][0]:
            new = at(0.5) if new[0] < points[-1][0] else at(-0.5)
            if new[0] >= points[-1][0]:
                best = np.array(points[0][1])
                points = sorted([points[0]] + [(f(x), tuple(x)) for x in (best + 0.5 * (np.array(p[1]) - best) for p in points[1:])])
                continue
        points = sorted(points[:-1] + [new])
    return np.array(points[0][1])


def fit_gaussian(h: np.ndarray, gamma: np.ndarray, weight: np.ndarray, nugget: float = NUGGET) -> tuple[float, float]:
    """Partial sill and range by least squares weighted with sqrt(pairs), in log space."""
    ok = (h > 0) & np.isfinite(gamma) & (weight > 0)
    h, gamma, weight = h[ok], gamma[ok], np.sqrt(weight[ok])
    if len(h) < 2:
        raise ValueError("a variogram needs at least two bins with distance")

    def loss(p) -> float:
        model = nugget + math.exp(p[0]) * (1 - np.exp(-((h / math.exp(p[1])) ** 2)))
        return float((weight * (gamma - model) ** 2).sum())

    p = nelder_mead(loss, [math.log(max(1e-8, float(np.median(gamma)) - nugget)), math.log(float(np.median(h)))])
    return math.exp(p[0]), math.exp(p[1])


def hyperparameters(obs: DataFrame, radius_km: float = 75.0, width_km: float = 25.0, nugget: float = NUGGET) -> DataFrame:
    """One row a mutation: ell_km = range / sqrt(2), tau2_year, psill, range_km; obs: mutation, id, year, day, x_km, y_km, z."""
    spark = obs.sparkSession
    bins = P.variogram_bins(obs, width_km).collect()
    tau = {r["mutation"]: r["tau2_year"] for r in P.tau2_near(obs, radius_km).collect()}
    rows = []
    for m in sorted({r["mutation"] for r in bins}):
        own = sorted((r for r in bins if r["mutation"] == m), key=lambda r: r["bin"])
        try:
            psill, reach = fit_gaussian(*(np.array([r[k] for r in own], float) for k in ("dist", "gamma", "np")), nugget=nugget)
        except ValueError:
            continue
        rows.append((m, reach / math.sqrt(2), tau.get(m), psill, reach, datetime.now(timezone.utc)))
    return spark.createDataFrame(rows, HYPERPARAMETERS)


def fitted_curve(spark, longest: float, psill: float, range_km: float, nugget: float = NUGGET, n: int = 500) -> DataFrame:
    h = spark.range(n).select((F.col("id") * (longest / (n - 1))).alias("dist"))
    return h.withColumn("gamma", X.gauss_variogram(F.col("dist"), psill, range_km, nugget))


def curves(far: DataFrame, psill: float, range_km: float, nugget: float = NUGGET, n: int = 500) -> DataFrame:
    """The fitted curve at n distances up to `far` of each row (mutation, far)."""
    h = far.withColumn("dist", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * (F.col("far") / (n - 1))))).drop("far")
    return h.withColumn("gamma", X.gauss_variogram(F.col("dist"), psill, range_km, nugget))


def weighted_loss(bins: DataFrame, psill: float, range_km: float, nugget: float = NUGGET, by: tuple[str, ...] = ("mutation",)) -> DataFrame:
    e = F.col("gamma") - X.gauss_variogram(F.col("dist"), psill, range_km, nugget)
    return bins.filter("dist > 0").groupBy(*by).agg(F.sum(F.sqrt("np") * e * e).alias("loss"))
