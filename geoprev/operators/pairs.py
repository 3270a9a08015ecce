"""Pairs of observations: distances, lags, variogram bins, tau squared, log-likelihood.

Pairs within a radius meet on cells of its size: one side goes to its own cell, the other to the nine around its own, and the cell
is part of the join's key beside the lag (next year, 365 days), so pairs of cells that aren't neighbours are never made. Sums over pairs
don't need the pairs of surveys at all: surveys of one place and time are summed first (n, sum of z, sum of z^2), pairs of places carry
n1 n2 and the sum of (z1 - z2)^2. The log-likelihood needs all pairs of places; blocks of them meet two at a time in a kernel that returns two
numbers. Only the full distance table is one of n (n - 1) / 2 rows, by definition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def planar(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pair_distances(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each unordered pair (ind1 > ind2) inside the groups `by`: dist_space, |dist_time|, signed dist_z = z1 - z2."""
    by = by or []
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in (*by, "id", "x", "y", "t", "z")])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in (*by, "id", "x", "y", "t", "z")])
    on = F.col("a_id") > F.col("b_id")
    for c in by:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, on).select(
        *[F.col(f"a_{c}").alias(c) for c in by], F.col("a_id").alias("ind1"), F.col("b_id").alias("ind2"),
        planar(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")).alias("dist_space"),
        F.abs(F.col("a_t") - F.col("b_t")).alias("dist_time"), (F.col("a_z") - F.col("b_z")).alias("dist_z"))


def _near(a: DataFrame, b: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, Column]:
    """a with its cell, b with the cells around its own, and the condition that they are the same; coordinates a_x_km, a_y_km, b_x_km, b_y_km."""
    size = radius * (1 + 1e-9) or 1.0
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    a = a.withColumn("a_cx", cell("a_x_km")).withColumn("a_cy", cell("a_y_km"))
    b = b.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    b = b.withColumn("b_cx", cell("b_x_km") + F.col("_dx")).withColumn("b_cy", cell("b_y_km") + F.col("_dy")).drop("_dx", "_dy")
    return a, b, (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))


def _side(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def _apart() -> Column:
    return planar(F.col("a_x_km"), F.col("a_y_km"), F.col("b_x_km"), F.col("b_y_km"))


def one_year_pairs(df: DataFrame, radius_km: float = 75.0, same: tuple[str, ...] = ("mutation",)) -> DataFrame:
    """Pairs a year apart within a radius, as a hash join on year + 1, the cell (and the columns in `same`); dz = z2 - z1."""
    cols = [*same, "id", "year", "x_km", "y_km", "z"]
    a, b, on = _near(_side(df, cols, "a").withColumn("next", F.col("a_year") + 1), _side(df, cols, "b"), radius_km)
    on = on & (F.col("next") == F.col("b_year"))
    for c in same:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, on).filter(_apart() <= radius_km).select(
        *[F.col(f"a_{c}").alias(c) for c in same], F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), F.col("a_year").alias("year"),
        _apart().alias("dist"), (F.col("b_z") - F.col("a_z")).alias("dz"))


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number, sum and sum of squares of z by place and time."""
    return df.groupBy(*keys).agg(F.count("z").alias("n"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("q"))


def _squares() -> Column:
    """Sum of (z1 - z2)^2 over the pairs of surveys of two places."""
    return F.greatest(F.col("a_n") * F.col("b_q") + F.col("b_n") * F.col("a_q") - 2 * F.col("a_s") * F.col("b_s"), F.lit(0.0))


def tau2_near(df: DataFrame, radius_km: float = 75.0, by: tuple[str, ...] = ("mutation",)) -> DataFrame:
    """tau2(one_year_pairs(df)) from pairs of places: the mean squared change of pairs a year apart within a radius, and their number."""
    cols = [*by, "year", "x_km", "y_km", "n", "s", "q"]
    places = moments(df, cols[:-3])
    a, b, on = _near(_side(places, cols, "a").withColumn("next", F.col("a_year") + 1), _side(places, cols, "b"), radius_km)
    on = on & (F.col("next") == F.col("b_year"))
    for c in by:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    met = a.join(b, on).filter(_apart() <= radius_km).select(*[F.col(f"a_{c}").alias(c) for c in by], _squares().alias("ss"), (F.col("a_n") * F.col("b_n")).alias("np"))
    sums = met.groupBy(*by).agg(F.sum("ss").alias("ss"), F.coalesce(F.sum("np"), F.lit(0)).alias("np"))
    return sums.select(*by, (F.col("ss") / F.nullif(F.col("np"), F.lit(0))).alias("tau2_year"), F.col("np").alias("n_pairs"))


def tau2(pairs: DataFrame, by: tuple[str, ...] = ("mutation",)) -> DataFrame:
    """Random-walk variance a year: the mean squared change."""
    return pairs.groupBy(*by).agg(F.avg(F.col("dz") * F.col("dz")).alias("tau2_year"), F.count("dz").alias("n_pairs"))


def variogram_bins(df: DataFrame, width_km: float = 25.0, lag_days: int = 365, by: tuple[str, ...] = ("mutation",), cutoff_km: float | None = None) -> DataFrame:
    """Bins of pairs exactly lag_days apart: bin, dist (mean), gamma (half the mean squared difference), np; with a cutoff, pairs meet on cells."""
    cols = [*by, "day", "x_km", "y_km", "n", "s", "q"]
    places = moments(df, cols[:-3]).filter("n > 0")
    a, b = _side(places, cols, "a").withColumn("then", F.date_add("a_day", lag_days)), _side(places, cols, "b")
    on = F.col("then") == F.col("b_day")
    if cutoff_km is not None:
        a, b, near = _near(a, b, cutoff_km)
        on = on & near
    for c in by:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    p = a.join(b, on).select(*[F.col(f"a_{c}").alias(c) for c in by], _apart().alias("d"), _squares().alias("ss"), (F.col("a_n") * F.col("b_n")).alias("np"))
    if cutoff_km is not None:
        p = p.filter(F.col("d") <= cutoff_km)
    return p.groupBy(*by, F.floor(F.col("d") / width_km).cast("long").alias("bin")).agg(
        (F.sum(F.col("d") * F.col("np")) / F.sum("np")).alias("dist"), (F.sum("ss") / F.sum("np") / 2).alias("gamma"), F.sum("np").alias("np"))


def vario_loglike(pairs: DataFrame, ls: float, lt: float, nugget: float, partial_sill: float, by: list[str] | None = None) -> DataFrame:
    """Sum of ln N(dist_z; 0, nugget + partial_sill (1 - rho))."""
    rho = X.vario_cor(F.col("dist_space"), F.col("dist_time"), ls, lt)
    c = nugget + partial_sill * (1 - rho)
    return pairs.groupBy(*(by or [])).agg(F.sum(X.log_normal_density(F.col("dist_z"), c)).alias("loglike"), F.count("dist_z").alias("n_pairs"))


def loglike_of_blocks(df: DataFrame, ls: float, lt: float, nugget: float, partial_sill: float, by: list[str] | None = None, ks: float = 1, kt: float = 2, block: int = 2048) -> DataFrame:
    """vario_loglike(pair_distances(df)) without rows of pairs: (by, loglike, n_pairs).

    Surveys of one place and time are one; blocks of places meet two at a time (each two once) and send two numbers.
    """
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    places = moments(rows, [*keys, "x", "y", "t"]).filter("n > 0")
    parts = places.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    dealt = places.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("x", "y", "t"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def density(n, ss, d, t) -> float:
        c = nugget + partial_sill * (1 - np.exp(-((d / ls) ** ks)) * np.exp(-((t / lt) ** kt)))
        ok = (c > 0) & (n > 0)
        return float(-0.5 * (n[ok] * np.log(2 * np.pi * c[ok]) + ss[ok] / c[ok]).sum())

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (pdf[pdf["part"] == pdf[k].iloc[0]].sort_values(["x", "y", "t"]) for k in ("lo", "hi"))
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        x, y, t, n, s, q = (second[c].to_numpy(float) for c in ("x", "y", "t", "n", "s", "q"))
        total, pairs = 0.0, 0
        for k in range(0, len(first), 256):
            a = first.iloc[k : k + 256]
            ax, ay, at, an, as_, aq = (a[c].to_numpy(float)[:, None] for c in ("x", "y", "t", "n", "s", "q"))
            m, ss = an * n, np.maximum(an * q + n * aq - 2 * as_ * s, 0)
            if same:  # each two places once, and the surveys of one place among themselves
                upper = np.arange(len(n)) > np.arange(k, k + len(a))[:, None]
                own = np.arange(len(n)) == np.arange(k, k + len(a))[:, None]
                m = np.where(upper, m, np.where(own, an * (an - 1) / 2, 0))
                ss = np.where(upper, ss, np.where(own, np.maximum(an * aq - as_**2, 0), 0))
            total += density(m, ss, np.sqrt((ax - x) ** 2 + (ay - y) ** 2), np.abs(at - t))
            pairs += int(m.sum())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "loglike": [total], "n_pairs": [pairs]})

    kinds = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in keys)
    sums = dealt.select(*keys, "lo", "hi", "part", "x", "y", "t", "n", "s", "q").groupBy(*keys, "lo", "hi").applyInPandas(pair, f"{kinds}, loglike double, n_pairs long")
    out = sums.groupBy(*keys).agg(F.sum("loglike").alias("loglike"), F.sum("n_pairs").alias("n_pairs")).filter("n_pairs > 0")
    return out if by else out.drop("_all")
