"""Schemas and units: `prevalence` and observed points are percent, raster `p` and draws are proportions, distances km."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATIONS = T.StructType([
    T.StructField("survey_id", T.StringType()), T.StructField("study_id", T.StringType()),
    T.StructField("collection_day", T.DateType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("year", T.IntegerType()),
    T.StructField("country_name", T.StringType()), T.StructField("numerator", T.DoubleType()),
    T.StructField("denominator", T.DoubleType()), T.StructField("prevalence", T.DoubleType()),
    T.StructField("mutation", T.StringType()),
])
SITE_KEYS = ["study_id", "survey_id", "year", "longitude", "latitude", "country_name"]
LONG_RASTER = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("t", T.IntegerType()), T.StructField("p", T.DoubleType())])
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
POLYGONS = T.StructType([T.StructField("id_0", T.StringType()), T.StructField("id_1", T.StringType()), T.StructField("name_0", T.StringType()), T.StructField("name_1", T.StringType()), T.StructField("rings", T.ArrayType(RING))])
HYPERPARAMETERS = T.StructType([T.StructField("mutation", T.StringType()), T.StructField("ell_km", T.DoubleType()), T.StructField("tau2_year", T.DoubleType()), T.StructField("psill", T.DoubleType()), T.StructField("range_km", T.DoubleType()), T.StructField("fitted_at", T.TimestampType())])


def require(df, columns) -> None:
    """Raise on missing columns before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
