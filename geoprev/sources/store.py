"""Readers and writers: observations, polygons, hyper-parameters, model tables, CSV files, cache paths."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import canonical
from ..schema import OBSERVATIONS, POLYGONS

EXTENSIONS = ("rds", "parquet", "rds.gz")


def cache_path(mutation: str, what: str, folder: str, ext: str = "rds") -> str:
    """<folder>/<mutation>_<what>.<ext>, with colons, slashes and blanks of the mutation as underscores."""
    if ext not in EXTENSIONS:
        raise ValueError(f"ext must be one of {EXTENSIONS}")
    return f"{folder.rstrip('/')}/{re.sub('[:/ ]', '_', mutation)}_{what}.{ext}"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header in the observation schema by name; unknown columns are dropped, NaN is NULL, bad days are NULL."""
    raw = spark.read.csv(path, header=True, nullValue="NA")
    missing = [f.name for f in OBSERVATIONS if f.name not in raw.columns and f.name not in ("collection_day", "prevalence")]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cols = []
    for f in OBSERVATIONS:
        kind = f.dataType.simpleString()
        c = F.col(f.name) if f.name in raw.columns else F.lit(None)
        cols.append((F.try_to_date(c.cast("string")) if kind == "date" else c.try_cast(kind)).alias(f.name))
    return canonical(raw.select(*cols))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLYGONS).parquet(path)


def read_hyperparameters(spark: SparkSession, path: str, key: str) -> dict:
    """The record of one mutation (or of the combined or pooled fit that stands in for it)."""
    row = spark.read.parquet(path).filter(F.col("mutation") == key).first()
    if row is None:
        raise ValueError(f"no hyper-parameters for {key!r}")
    return row.asDict()


def save_model(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet by mutation, so that a reader of one mutation reads one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("mutation").parquet(f"{folder.rstrip('/')}/{name}")


def load_model(spark: SparkSession, folder: str, name: str, mutation: str) -> DataFrame:
    """A stored table of one mutation; FileNotFoundError if there is none. Nothing is computed in its place."""
    path = f"{folder.rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    out = spark.read.parquet(path).filter(F.col("mutation") == mutation)
    if out.isEmpty():
        raise FileNotFoundError(f"{path}: no {mutation!r}")
    return out


def save_csv(df: DataFrame, name: str, folder: str, missing: str = "", append_date: bool = False, gzip: bool = False, single: bool = True, quote: bool = False) -> str:
    """A CSV folder with header (one file if single) and its path; missing values as the given text."""
    path = f"{folder.rstrip('/')}/{name}{'_' + date.today().isoformat() if append_date else ''}.csv{'.gz' if gzip else ''}"
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").csv(path, header=True, nullValue=missing, emptyValue="", quoteAll=quote, compression="gzip" if gzip else "none")
    return path
