"""Exact quantiles of whole columns by refining histograms: every pass is a combinable count, no task sorts or holds a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite


def _ranked(df: DataFrame, column: str, rank: int, low: float, high: float, buckets: int, enough: int) -> float:
    """The value of a rank (from 0) among the finite values; low and high are their limits."""
    value = F.col(column).cast("double")
    while low < high:
        width = high / buckets - low / buckets
        if not width > 0:  # neighbouring numbers
            width = high - low
        bucket = F.least(F.floor((value - low) / width), F.lit(buckets - 1)).cast("long")
        inside = df.filter(value.between(low, high))
        rows = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("b").collect()
        for r in rows:
            if rank < r["n"]:
                break
            rank -= r["n"]
        if r["n"] <= enough:
            return sorted(x[0] for x in df.filter(value.between(r["low"], r["high"])).select(value).collect())[rank]
        low, high = r["low"], r["high"]
    return low


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, buckets: int = 4096, enough: int = 1024) -> float | None:
    """The quantile by linear interpolation between ranks; NULL, NaN and infinite values are left out, None without others.

    Each pass brings at most `buckets` counts to the driver and goes on with the bucket of the rank; at most `enough` values come last.
    """
    rows = df.select(column).filter(is_finite(F.col(column).cast("double")))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(column).cast("double")).alias("low"), F.max(F.col(column).cast("double")).alias("high")).first()
    if r["n"] == 0:
        return None
    at = q * (r["n"] - 1)
    k = int(at)
    a = _ranked(rows, column, k, r["low"], r["high"], buckets, enough)
    b = a if at == k else _ranked(rows, column, k + 1, r["low"], r["high"], buckets, enough)
    return a + (b - a) * (at - k)
