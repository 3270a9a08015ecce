"""Column expressions. All stay inside the JVM; domains are guarded so that ANSI mode raises nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default prevalence breaks and the colours of a map.
PREV_BREAKS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)


def no_nan(c: Column) -> Column:
    """NaN becomes NULL, so that a missing value has one form."""
    return F.when(F.isnan(c), None).otherwise(c)


def canonical(df: DataFrame) -> DataFrame:
    """no_nan on every float column."""
    return df.select(*[no_nan(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)); NULL outside the open unit interval."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def plogis(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def emplogit(x: Column, n: Column) -> Column:
    """Empirical logit ln(x + 1/2) - ln(n - x + 1/2); NULL if n - x + 1/2 is not positive."""
    return F.when((x + 0.5 > 0) & (n - x + 0.5 > 0), F.ln(x + 0.5) - F.ln(n - x + 0.5))


def smoothed(x: Column, n: Column) -> Column:
    return (x + 0.5) / (n + 1)


def year_group(y: Column, odd: bool = False) -> Column:
    """Two-year label: 2012-2013 .. 2022-2023, or with odd starts 2001-2002 .. 2023-2024; NULL outside."""
    first, last = (2001, 2024) if odd else (2012, 2023)
    start = y - F.pmod(y + (1 if odd else 0), F.lit(2))
    return F.when(y.between(first, last), F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string")))


def block_label(c: Column) -> Column:
    """k13:561:H as 561H; other labels unchanged."""
    return F.regexp_replace(c, r"^k13:(\d+):([A-Za-z])$", "$1$2")


def map_title(c: Column) -> Column:
    """'k13 561H' for a single marker, '' for the combined one."""
    return F.when(c == "k13:comb", "").otherwise(F.concat(F.lit("k13 "), block_label(c)))


def area_title(c: Column) -> Column:
    """The label of area plots: prefix and colons stripped; 'k13 combined' for the combined marker."""
    return F.when(c == "k13:comb", "k13 combined").otherwise(F.replace(F.regexp_replace(c, "^k13:", ""), F.lit(":"), F.lit("")))


def vario_cor(ds: Column, dt: Column, ls: float, lt: float, ks: float = 1, kt: float = 2) -> Column:
    """Separable space-time correlation exp(-(ds/ls)^ks) exp(-(dt/lt)^kt)."""
    return F.exp(-F.pow(ds / ls, F.lit(float(ks)))) * F.exp(-F.pow(dt / lt, F.lit(float(kt))))


def gauss_variogram(h: Column, psill: Column | float, range_km: Column | float, nugget: float = 0.8) -> Column:
    return F.lit(nugget) + F.lit(psill) * (1 - F.exp(-F.pow(h / F.lit(range_km), F.lit(2.0))))


def pg_weight(n: Column, z: Column) -> Column:
    """Mean of a Polya-Gamma variable: n/(2|z|) tanh(|z|/2), n/4 near zero or if z is not finite; at least 1e-10."""
    a = F.greatest(F.abs(z), F.lit(1e-6))
    w = F.when(~is_finite(z) | (F.abs(z) < 1e-6), n / 4).otherwise(0.5 * n / a * F.tanh(a / 2))
    return F.when(n.isNull(), None).otherwise(F.greatest(w, F.lit(1e-10)))


def log_normal_density(z: Column, variance: Column) -> Column:
    """ln N(z; 0, variance); NULL unless the variance is positive."""
    return F.when(variance > 0, -0.5 * (F.ln(2 * math.pi * variance) + z * z / variance))


def midyear(year: Column) -> Column:
    return F.make_date(year, F.lit(7), F.lit(1))


def survey_day(mutation: Column, year: Column, day: Column, combined: str = "k13:comb") -> Column:
    """1 July of the year for combined rows, which have no day of their own; else the collection day."""
    return F.when(mutation == combined, midyear(year)).otherwise(day)


def prev_vals(breaks=PREV_BREAKS) -> list[float]:
    lo, hi = min(breaks), max(breaks)
    return [(b - lo) / (hi - lo) for b in breaks]


def axis_ticks(lo: float, hi: float, step: float) -> list[float]:
    a, b = math.floor(lo / step), math.ceil(hi / step)
    return [k * step for k in range(a, b + 1)]


def buffer_vector(x: list[float], n: int) -> list[float]:
    """n more steps on each side of an increasing vector, of the width of its first step."""
    if n < 0:
        raise ValueError("n must not be negative")
    if len(x) < 2 or any(b <= a for a, b in zip(x, x[1:])):
        raise ValueError("x must increase")
    d = x[1] - x[0]
    return [x[0] - d * k for k in range(n, 0, -1)] + list(x) + [x[-1] + d * k for k in range(1, n + 1)]


def cell_area_km2(lon: tuple[float, float], lat: tuple[float, float], nx: int, ny: int) -> float:
    """Area of a grid cell at the middle latitude, 111.32 km a degree."""
    mid = (lat[0] + lat[1]) / 2
    dx = (lon[1] - lon[0]) / (nx - 1) * 111.32 * math.cos(mid * math.pi / 180)
    return dx * (lat[1] - lat[0]) / (ny - 1) * 111.32
