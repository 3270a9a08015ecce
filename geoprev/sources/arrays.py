"""Dense arrays over time, a grid and draws, kept as chunks: a slice reads the chunks that it meets and no others.

A chunk is a row (t, cy, cx, cd, at, values): its block of rows, columns and draws, the places inside the block that have a value, and
these values. Chunks of a time lie in a folder of their own and are sorted by block, so a filter on time prunes folders, and filters on
blocks reach the statistics of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a block by rows and columns, and draws of a block.
CHUNK = (32, 32, 64)
AXES = ("iy", "ix", "draw")


def write_array(df: DataFrame, path: str, value: str = "p", chunk: tuple[int, int, int] = CHUNK) -> None:
    """df: t, iy, ix, draw (whole numbers from 0) and the value. Cells without a row, or with NULL, are missing; cells may come once only."""
    blocks = [F.floor(F.col(a) / n).cast("int").alias(c) for a, n, c in zip(AXES, chunk, ("cy", "cx", "cd"))]
    inside = [F.col(a) - F.floor(F.col(a) / n) * n for a, n in zip(AXES, chunk)]
    at = ((inside[0] * chunk[1] + inside[1]) * chunk[2] + inside[2]).cast("int").alias("at")
    rows = df.select("t", *blocks, at, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    cells = rows.groupBy("t", "cy", "cx", "cd").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))  # a chunk at most
    cells = cells.select("t", "cy", "cx", "cd", F.col("cells.at").alias("at"), F.col("cells.v").alias("values"))
    doubled = F.size(F.array_distinct("at")) < F.size("at")
    cells = cells.filter(F.when(doubled, F.raise_error(F.lit("a cell of the array comes twice")).cast("boolean")).otherwise(F.lit(True)))
    cells.repartitionByRange("t", "cy", "cx", "cd").sortWithinPartitions("t", "cy", "cx", "cd").write.mode("overwrite").partitionBy("t").option("parquet.block.size", 1 << 20).parquet(path)


def chunks(spark: SparkSession, path: str, t: list[int] | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, draws: tuple[int, int] | None = None,
           chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """The chunks that a slice meets; ranges hold both ends."""
    out = spark.read.parquet(path)
    if t is not None:
        out = out.filter(F.col("t").isin(t))
    for c, limits, n in zip(("cy", "cx", "cd"), (rows, columns, draws), chunk):
        if limits is not None:
            out = out.filter(F.col(c).between(limits[0] // n, limits[1] // n))
    return out


def read_array(spark: SparkSession, path: str, t: list[int] | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, draws: tuple[int, int] | None = None,
               chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """(t, iy, ix, draw, p) of a slice: some times, and ranges of rows, columns and draws (both ends in)."""
    cells = chunks(spark, path, t, rows, columns, draws, chunk).select("t", "cy", "cx", "cd", F.explode(F.arrays_zip("at", "values")).alias("c"))
    at, (n_rows, n_columns, n_draws) = F.col("c.at"), chunk

    def part(step: int, n: int) -> Column:
        return F.pmod(F.floor(at / step), F.lit(n)).cast("int")

    out = cells.select("t", (F.col("cy") * n_rows + part(n_columns * n_draws, n_rows)).alias("iy"), (F.col("cx") * n_columns + part(n_draws, n_columns)).alias("ix"),
                       (F.col("cd") * n_draws + part(1, n_draws)).alias("draw"), F.col("c.values").alias("p"))
    for c, limits in zip(AXES, (rows, columns, draws)):
        if limits is not None:
            out = out.filter(F.col(c).between(*limits))
    return out
