"""Report tables: two-year means, exceedance, intervals, areas, admin means, peaks, lookups and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..parameters import PREVALENCE_COLOURS
from .grid import pivot_years


def avg_blocks(df: DataFrame, odd: bool = False) -> DataFrame:
    """Mean p by cell and two-year block; years outside the blocks form one block NULL that is kept."""
    return df.groupBy("x", "y", X.year_group(F.col("t"), odd).alias("t")).agg(F.avg(X.no_nan(F.col("p"))).alias("p"))


def exceedance(df: DataFrame, keys: list[str], value: str = "p", thresholds: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Share of draws strictly above each threshold, as columns ex_<percent>: one pass, no join of three surfaces."""
    return df.groupBy(*keys).agg(*[F.avg((F.col(value) > t).cast("double")).alias(f"ex_{round(100 * t)}") for t in thresholds])


def exceedance_long(df: DataFrame, threshold: float, name: str, keys: list[str]) -> DataFrame:
    """One threshold as a surface of its own, to be joined by cell."""
    return df.groupBy(*keys).agg(F.avg((F.col("p") > threshold).cast("double")).alias(name))


def posterior_summary(df: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """Mean, median and the width of the central 95 % interval (linear interpolation)."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), q.alias("q")).select(*keys, "mean", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("ci_width"))


def region_draw_mean(df: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_p"))


def region_interval(df: DataFrame, keys: list[str], value: str = "mean_p") -> DataFrame:
    """Quantiles of the draws; mean_prevalence is the median, as the name is used in reports."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lower"), F.col("q")[1].alias("mean_prevalence"), F.col("q")[2].alias("upper"))


def area_over_time(surface: DataFrame, cell_area: float, keys: list[str], columns: list[str], limit: float = 0.8) -> DataFrame:
    """Cells whose exceedance probability is above the limit, and their area, by time."""
    n = [F.coalesce(F.sum((F.col(c) > limit).cast("long")), F.lit(0)).alias(f"n_{c}") for c in columns]
    return surface.groupBy(*keys).agg(*n).select(*keys, *[f"n_{c}" for c in columns], *[(F.col(f"n_{c}") * cell_area).alias(f"area_{c}") for c in columns])


def admin_year_mean(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean percent over the cells of a region, and the number of cells, empty ones included."""
    return cells.groupBy(*keys).agg(F.avg(100 * F.col("p")).alias("mean_p"), F.count(F.lit(1)).alias("n_cells"))


def prevalence_per_year(df: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Wide by two years; prev_per_year keeps the report's extra factor 100, percent_per_year has none."""
    wide = pivot_years(df, keys, "t", [first, last], ["mean_p"])
    rise = (F.col(f"y_{last}") - F.col(f"y_{first}")) / (last - first)
    return wide.withColumn("prev_per_year", rise * 100).withColumn("percent_per_year", rise)


def _holds(bad: Column, message: Column | str) -> Column:
    """A condition that is true, or stops the job with a message where a row is bad."""
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Left join to a distinct lookup; with strict, the job stops at a row whose key repeats in the lookup or isn't in it.

    The check is part of the join's own job: rows of the lookup carry how often their key comes, and no row is read twice.
    """
    right = lookup.select(key, *columns).distinct()
    if not strict:
        return df.join(right, key, "left")
    once = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    out = df.join(once, key, "left")
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    return out.filter(_holds(F.col("_n").isNull(), F.concat(F.lit(f"{key} is not in the lookup: "), name)) & _holds(F.col("_n") > 1, F.concat(F.lit(f"{key} repeats in the lookup: "), name))).drop("_n")


def missing(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(lookup.select(key).distinct(), key, "left_anti")


def last_point(df: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Rows of the latest time of each group, ties kept; by a grouped maximum, not a window over the group."""
    top = df.groupBy(*keys).agg(F.max(time).alias("_top"))
    return df.alias("a").join(top.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{time}") == F.col("b._top")]).select("a.*")


def peak(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """The row with the greatest value of each group, ties to the first in the order of `ties`: a combinable maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*ties, *[c for c in rest if c not in ties and c != value])).alias("r"))
    top = best.groupBy(*keys).agg(F.max_by("r", value).alias("r"), F.max(value).alias(value))
    return top.select(*keys, value, *[F.col(f"r.{c}").alias(c) for c in rest if c != value])


def ranked_peak(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """The same by a window, for groups known to be small."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *ties)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def named(column: Column, names: dict[str, str]) -> Column:
    """A value for each name, NULL if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with its rows counted by whatever job reads it; the count is there when that job is done."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def checked_equal_rows(a: Observation, b: Observation, what: str) -> None:
    """Raises if two counted tables of a job that is done had not as many rows; no job of its own."""
    n, m = a.get["rows"], b.get["rows"]
    if n != m:
        raise ValueError(f"{what}: {n} rows became {m}")


def sample_rows(df: DataFrame, n: int, seed: int, order: list[str]) -> DataFrame:
    """n rows without replacement, the same for the same seed; raises if there are fewer."""
    picked = df.withColumn("_h", F.xxhash64(F.lit(seed), *order)).orderBy("_h", *order).limit(n).drop("_h")
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return picked


def map_layers(raster: DataFrame, points: DataFrame | None, x_step: float, y_step: float, label: str = "Prevalence (%)") -> dict:
    """What a map needs: fill (percent), points in the order of p, ticks, colour stops and the legend's label."""
    box = raster.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    fill = raster.withColumn("fill", 100 * F.col("p"))
    return {"raster": fill, "points": points.orderBy("p") if points is not None else None, "x_ticks": X.axis_ticks(box[0], box[1], x_step), "y_ticks": X.axis_ticks(box[2], box[3], y_step), "stops": X.prev_vals(), "colours": PREVALENCE_COLOURS, "label": label}
