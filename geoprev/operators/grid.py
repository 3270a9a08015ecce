"""Grids and reshaping: axes, cells, long rasters, draws, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Box
from ..shared import stored


def axis(lo: float, hi: float, n: int) -> Column:
    """n equally spaced values as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * ((hi - lo) / (n - 1)))


def grid(spark: SparkSession, box: Box, nx: int, ny: int) -> DataFrame:
    """pixel (from 1, x fastest), ix, iy, x, y; made on the executors, nothing is collected."""
    dx, dy = (box.xmax - box.xmin) / (nx - 1), (box.ymax - box.ymin) / (ny - 1)
    cell = spark.range(nx * ny).select(F.col("id"), (F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    return cell.select((F.col("id") + 1).alias("pixel"), "ix", "iy", (F.lit(box.xmin) + F.col("ix") * dx).alias("x"), (F.lit(box.ymin) + F.col("iy") * dy).alias("y"))


def raster_long(flat: DataFrame, xs: list[float], ys: list[float], values: str = "values") -> DataFrame:
    """(x, y, t, p) from rows (t, values) with a flat array a time, x fastest."""
    n = len(xs)
    ax, ay = F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys)))
    rows = flat.select("t", F.posexplode(values).alias("pos", "p")).filter(F.col("pos") < n * len(ys))
    return rows.select(F.element_at(ax, F.col("pos") % n + 1).alias("x"), F.element_at(ay, F.floor(F.col("pos") / n).cast("int") + 1).alias("y"), "t", "p")


def raster_of(spark: SparkSession, cells: DataFrame, years: list[int], value: Column) -> DataFrame:
    """(x, y, t, p) for all cells and years; years are few and exploded from a literal."""
    return cells.withColumn("t", F.explode(F.array(*map(F.lit, years)))).select("x", "y", "t", value.alias("p"))


def draws_long(df: DataFrame, keys: list[str], draws: str) -> DataFrame:
    """One row a draw: keys, draw (from 1), value."""
    return df.select(*keys, F.posexplode(draws).alias("draw", "value")).withColumn("draw", F.col("draw") + 1)


def pivot_years(df: DataFrame, keys: list[str], year: str, years: list[int], values: list[str], prefix: str = "y_") -> DataFrame:
    """Wide by year: <value>_y_<year>, or y_<year> for a single value."""
    one = len(values) == 1
    cells = [F.max(F.when(F.col(year) == y, F.col(v))).alias(f"{prefix}{y}" if one else f"{v}_{prefix}{y}") for v in values for y in years]
    return df.groupBy(*keys).agg(*cells)


def yearly_rate(first: Column, last: Column, years: int = 12) -> Column:
    return (last - first) / years


def with_row_number(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """A surrogate index from 1 in a total order, by two-level counting instead of one task.

    Rows are dealt by ranges and written once, so that a range holds the same rows for whatever reads it; the counts of the ranges, a row
    each, come to the driver and give the numbers before each range.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, bases = 0, []
    for r in ranges.groupBy("_part").count().orderBy("_part").collect():
        bases.append((r["_part"], before))
        before += r["count"]
    base = df.sparkSession.createDataFrame(bases, "_part int, _base long")
    local = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_n")).drop("_part", "_n", "_base")


def with_level(df: DataFrame, column: str, name: str = "level", levels: list | None = None) -> DataFrame:
    """An ordered factor: the place (from 1) of each value among the given levels, or among all values in order; NULL has none.

    Without levels, the distinct values are numbered, not the rows.
    """
    if levels is not None:
        return df.withColumn(name, F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0)).cast("int"))
    values = with_row_number(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], name).withColumn(name, F.col(name).cast("int"))
    return df.join(values, column, "left").select(*df.columns, name)
