"""Tables between two steps of a plan: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a temp folder if all runs in one process, or a folder in the warehouse."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/geoprev-steps"
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="geoprev-steps-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a written table: made once, whatever reads them, and safe from lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of the session hold no more than this (or one row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
