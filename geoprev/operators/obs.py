"""Observation tables: filters, the combined marker, observed points, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.geo import Box
from ..schema import SITE_KEYS, require


def valid_counts(df: DataFrame) -> DataFrame:
    """Rows with finite counts and a positive denominator."""
    return df.filter(X.is_finite(F.col("numerator")) & X.is_finite(F.col("denominator")) & (F.col("denominator") > 0))


def add_combined(df: DataFrame, pattern: str = "^k13", label: str = "k13:comb", ordered: bool = True) -> DataFrame:
    """The input and, for each site and year, one row for all markers that match: numerators summed, the largest denominator.

    Columns besides the site keys and counts are NULL in new rows. A combined numerator can exceed its denominator.
    """
    require(df, [*SITE_KEYS, "numerator", "denominator", "mutation"])
    rows = df.filter(F.coalesce(F.col("mutation").rlike(f"(?i){pattern}"), F.lit(False)))
    new = rows.groupBy(*SITE_KEYS).agg(
        F.coalesce(F.sum("numerator"), F.lit(0.0)).alias("numerator"), F.max("denominator").alias("denominator")).withColumn(
        "prevalence", 100 * F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0))).withColumn("mutation", F.lit(label))
    out = df.unionByName(new, allowMissingColumns=True)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in ("year", "longitude", "latitude", "mutation")]) if ordered else out


def with_logit(df: DataFrame) -> DataFrame:
    """Adds p_hat, the smoothed proportion, and z, its logit (NULL where p_hat is not below 1)."""
    p = X.smoothed(F.col("numerator"), F.col("denominator"))
    return df.withColumn("p_hat", p).withColumn("z", X.logit(F.col("p_hat")))


def add_year_group(df: DataFrame, year: str = "year", odd: bool = False) -> DataFrame:
    return df.withColumn("year_group", X.year_group(F.col(year), odd))


def crop(df: DataFrame, x: tuple[float, float], y: tuple[float, float], x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Rows in the closed rectangle; NULL coordinates drop out."""
    return df.filter(F.col(x_col).between(*x) & F.col(y_col).between(*y))


def in_box(df: DataFrame, box: Box, x_col: str = "longitude", y_col: str = "latitude") -> DataFrame:
    return crop(df, (box.xmin, box.xmax), (box.ymin, box.ymax), x_col, y_col)


def open_longitude(df: DataFrame, lo: float = -20, hi: float = 55, after: int = 2011) -> DataFrame:
    """Strictly between two longitudes and after a year; no latitude limit."""
    return df.filter((F.col("longitude") > lo) & (F.col("longitude") < hi) & (F.col("year") > after))


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is none of these; a missing value is none of them."""
    return df.filter(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def observed_points(df: DataFrame, box: Box, first: int, last: int) -> DataFrame:
    """x, y, t, p (percent) of the surveys in a window."""
    rows = in_box(df.filter(F.col("year").between(first, last)), box)
    return rows.select(F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.col("year").alias("t"),
                       (100 * F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0))).alias("p"), "mutation")


def points_by_block(points: DataFrame, years: list[int], odd: bool = False) -> DataFrame:
    """Points of some years, t replaced by the two-year label."""
    return points.filter(F.col("t").isin(years)).withColumn("t", X.year_group(F.col("t"), odd))


def with_positives(df: DataFrame, value: str = "prevalence") -> DataFrame:
    """Rows of the mutations that have a positive value anywhere."""
    found = df.filter(F.col(value) > 0).select("mutation").distinct()
    return df.join(found, "mutation", "left_semi")


def ever_above(df: DataFrame, keys: list[str], value: str, cutoff: float) -> DataFrame:
    """Rows of the groups in which some value is above the cutoff: a semi-join, so no group meets in one task."""
    found = df.filter(F.col(value) > cutoff).select(*keys).distinct()
    return df.alias("a").join(found.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_semi")


def excluding(df: DataFrame, rules: list[tuple[str, list[str]]], region: str = "name_1") -> DataFrame:
    """Drops the (region, mutations) pairs of the rules."""
    bad: Column = F.lit(False)
    for name, mutations in rules:
        bad = bad | ((F.col(region) == name) & F.col("mutation").isin(mutations))
    return df.filter(~F.coalesce(bad, F.lit(False)))
