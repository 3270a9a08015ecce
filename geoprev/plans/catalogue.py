"""Queries of the prevalence-mapping operators, with DuckDB SQL of the same results.

The tables hold no surveys, so `surveys` builds them from order lines: a survey is a nation, a marker a part's remainder,
positives are returned lines. Draws come from the embeddings: pixel, position and label stand for cell, draw and region.
"""

from __future__ import annotations

import dataclasses
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import geo
from ..functions import validate as V
from ..operators import grid as G
from ..operators import obs as O
from ..operators import pairs as P
from ..operators import report as R
from ..operators import spatial as S
from ..operators.quantiles import exact_quantile
from .. import shared
from ..shared import stored
from ..sources import arrays as A
from ..streaming import blocks as B
from . import kalman, model, rff, ridge, simulate, variogram

QUERIES: dict = {}
ORACLE: dict = {}

#: The markers that stand for part keys modulo 5, and cut-offs of the reports.
MUTATIONS = ("k13:561:H", "k13:622:I", "k13:675:V", "crt:76:T", "mdr1:86:Y")
CUTOFF = 0.1
BOX = geo.EAST_AFRICA
OMEGA = ((0.01, 0.02), (-0.015, 0.005), (0.003, -0.01))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey table; lines are counted by order, marker before they meet customers, so the joins carry counts."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    parts = _read(spark, sf_dir, "part", "p_partkey")
    lines = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey", (F.col("p_partkey") % 5).cast("int").alias("m")).agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("pos"), F.count(F.lit(1)).alias("n"))
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers, nations = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy("c_nationkey", (F.year("o_orderdate") + 20).cast("int").alias("year"), "m").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    k = F.col("n_nationkey")
    names = F.array(*map(F.lit, MUTATIONS))
    return counts.join(nations, F.col("c_nationkey") == k).select(
        k.cast("string").alias("survey_id"), (k % 5).cast("string").alias("study_id"),
        (F.lit(27.0) + (k % 5) * F.lit(4.0)).alias("longitude"), (F.lit(-5.0) + F.floor(k / 5) * F.lit(5.0)).alias("latitude"), "year",
        F.col("n_name").alias("country_name"), F.col("pos").cast("double").alias("numerator"), F.col("n").cast("double").alias("denominator"),
        (100 * F.col("pos").cast("double") / F.col("n")).alias("prevalence"), names[F.col("m")].alias("mutation"))


_CASE = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MUTATIONS))
OBS = f"""obs AS (SELECT CAST(n_nationkey AS VARCHAR) AS survey_id, CAST(n_nationkey % 5 AS VARCHAR) AS study_id,
  CAST(27 + (n_nationkey % 5) * 4 AS DOUBLE) AS longitude, CAST(-5 + (n_nationkey // 5) * 5 AS DOUBLE) AS latitude,
  CAST(year(o_orderdate) + 20 AS INTEGER) AS year, n_name AS country_name,
  CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS numerator, CAST(count(*) AS DOUBLE) AS denominator,
  100 * CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS prevalence, CASE p_partkey % 5 {_CASE} END AS mutation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY n_nationkey, n_name, year(o_orderdate), p_partkey % 5)"""
COMBINED = """new AS (SELECT survey_id, study_id, longitude, latitude, year, country_name, sum(numerator) AS numerator, max(denominator) AS denominator,
  100 * sum(numerator) / max(denominator) AS prevalence, 'k13:comb' AS mutation FROM obs WHERE regexp_matches(mutation, '^k13', 'i') GROUP BY ALL),
com AS (SELECT * FROM obs UNION ALL BY NAME SELECT * FROM new)"""
PHAT = "(numerator + 0.5) / (denominator + 1)"
LOGIT = f"CASE WHEN {PHAT} < 1 THEN ln({PHAT} / (1 - {PHAT})) END"
OBS_COLUMNS = "survey_id, study_id, longitude, latitude, year, country_name, numerator, denominator, round(prevalence, 6) AS prevalence, mutation"


def _group_sql(y: str, odd: bool = False) -> str:
    lo, hi, shift = (2001, 2024, 1) if odd else (2012, 2023, 0)
    s = f"({y} - ({y} + {shift}) % 2)"
    return f"CASE WHEN {y} BETWEEN {lo} AND {hi} THEN CAST({s} AS VARCHAR) || '-' || CAST({s} + 1 AS VARCHAR) END"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def combined(spark, sf_dir) -> DataFrame:
    return O.add_combined(surveys(spark, sf_dir), ordered=False)


@query(f"WITH {OBS}, {COMBINED}, b AS (SELECT mutation, country_name, {_group_sql('year')} AS year_group, {PHAT} AS p_hat FROM com WHERE denominator > 0) SELECT mutation, country_name, year_group, round(avg(p_hat), 6) AS mean_p, count(*) AS n_surveys FROM b GROUP BY mutation, country_name, year_group")
def prevalence_blocks(spark, sf_dir):
    df = O.add_year_group(O.with_logit(O.valid_counts(combined(spark, sf_dir))))
    return df.groupBy("mutation", "country_name", "year_group").agg(F.round(F.avg("p_hat"), 6).alias("mean_p"), F.count(F.lit(1)).alias("n_surveys"))


@query(f"WITH {OBS}, {COMBINED} SELECT {OBS_COLUMNS} FROM com")
def obs_combined(spark, sf_dir):
    return _rounded(O.add_combined(surveys(spark, sf_dir)), "prevalence")


@query(f"WITH {OBS}, {COMBINED} SELECT {OBS_COLUMNS}, round({PHAT}, 6) AS p_hat, round({LOGIT}, 6) AS z FROM com WHERE isfinite(numerator) AND isfinite(denominator) AND denominator > 0")
def obs_valid_logit(spark, sf_dir):
    return _rounded(O.with_logit(O.valid_counts(combined(spark, sf_dir))), "prevalence", "p_hat", "z")


@query(f"WITH {OBS} SELECT survey_id, year, mutation, round(ln(numerator + 0.5) - ln(denominator - numerator + 0.5), 6) AS z FROM obs")
def emplogit(spark, sf_dir):
    return surveys(spark, sf_dir).select("survey_id", "year", "mutation", F.round(X.emplogit(F.col("numerator"), F.col("denominator")), 6).alias("z"))


#: Every year from 20 before a survey to 10 after it.
_YEARS = "y AS (SELECT DISTINCT CAST(year + d AS INTEGER) AS year FROM obs, range(-20, 11) r(d))"


def _years(spark, sf_dir):
    return surveys(spark, sf_dir).select("year").distinct().select(F.explode(F.sequence(F.col("year") - 20, F.col("year") + 10)).alias("year")).distinct()


@query(f"WITH {OBS}, {_YEARS} SELECT year, {_group_sql('year')} AS year_group FROM y")
def year_group(spark, sf_dir):
    return O.add_year_group(_years(spark, sf_dir))


@query(f"WITH {OBS}, {_YEARS} SELECT year, {_group_sql('year', True)} AS year_group FROM y")
def year_group_pd(spark, sf_dir):
    return O.add_year_group(_years(spark, sf_dir), odd=True)


def _long(spark, sf_dir):
    return surveys(spark, sf_dir).select(F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.col("year").alias("t"), (F.col("numerator") / F.col("denominator")).alias("p"), "mutation")


_LONG = "l AS (SELECT longitude AS x, latitude AS y, year AS t, numerator / denominator AS p, mutation FROM obs)"


@query(f"WITH {OBS}, {_LONG} SELECT x, y, {_group_sql('t')} AS t, round(avg(p), 6) AS p FROM l GROUP BY ALL")
def avg_2_year(spark, sf_dir):
    return _rounded(R.avg_blocks(_long(spark, sf_dir)), "p")


@query(f"WITH {OBS}, {_LONG} SELECT x, y, {_group_sql('t', True)} AS t, round(avg(p), 6) AS p FROM l GROUP BY ALL")
def avg_2_year_pd(spark, sf_dir):
    return _rounded(R.avg_blocks(_long(spark, sf_dir), odd=True), "p")


@query(f"WITH {OBS}, {_LONG} SELECT x, y, t, round(p, 6) AS p, mutation FROM l WHERE x BETWEEN 28 AND 37 AND y BETWEEN -5 AND 5")
def crop_long(spark, sf_dir):
    return _rounded(O.crop(_long(spark, sf_dir), (28, 37), (-5, 5)), "p")


@query(f"WITH {OBS} SELECT survey_id, mutation, longitude, year FROM obs WHERE longitude > 27 AND longitude < 43 AND year > 2016")
def open_range_filter(spark, sf_dir):
    return O.open_longitude(surveys(spark, sf_dir), 27, 43, 2016).select("survey_id", "mutation", "longitude", "year")


@query(f"WITH {OBS}, {COMBINED} SELECT DISTINCT mutation, regexp_replace(mutation, '^k13:(\\d+):([A-Za-z])$', '\\1\\2') AS label, CASE WHEN mutation = 'k13:comb' THEN '' ELSE 'k13 ' || regexp_replace(mutation, '^k13:(\\d+):([A-Za-z])$', '\\1\\2') END AS title, CASE WHEN mutation = 'k13:comb' THEN 'k13 combined' ELSE replace(regexp_replace(mutation, '^k13:', ''), ':', '') END AS area_label FROM com")
def clean_labels(spark, sf_dir):
    m = F.col("mutation")
    return combined(spark, sf_dir).select(m, X.block_label(m).alias("label"), X.map_title(m).alias("title"), X.area_title(m).alias("area_label")).distinct()


_POINTS = f"p AS (SELECT longitude AS x, latitude AS y, year AS t, 100 * numerator / nullif(denominator, 0) AS p, mutation FROM obs WHERE year BETWEEN 2015 AND 2020 AND longitude BETWEEN {BOX.xmin} AND {BOX.xmax} AND latitude BETWEEN {BOX.ymin} AND {BOX.ymax})"


@query(f"WITH {OBS}, {_POINTS} SELECT x, y, t, round(p, 6) AS p, mutation FROM p")
def observed_points(spark, sf_dir):
    return _rounded(O.observed_points(surveys(spark, sf_dir), BOX, 2015, 2020), "p")


@query(f"WITH {OBS}, {_POINTS} SELECT x, y, {_group_sql('t')} AS t, round(p, 6) AS p, mutation FROM p WHERE t IN (2016, 2017, 2019)")
def observed_points_2y(spark, sf_dir):
    return _rounded(O.points_by_block(O.observed_points(surveys(spark, sf_dir), BOX, 2015, 2020), [2016, 2017, 2019]), "p")


_EXTENT = "e AS (SELECT min(longitude) - 1.0 AS x0, max(longitude) + 1.0 AS x1, min(latitude) - 1.0 AS y0, max(latitude) + 1.0 AS y1 FROM obs)"


@query(f"WITH {OBS}, {_EXTENT} SELECT CAST(i + 1 AS BIGINT) AS pixel, CAST(i % 20 AS INTEGER) AS ix, CAST(i // 20 AS INTEGER) AS iy, round(x0 + (i % 20) * ((x1 - x0) / 19), 6) AS x, round(y0 + (i // 20) * ((y1 - y0) / 19), 6) AS y FROM range(400) r(i), e")
def grid_cells(spark, sf_dir):
    """A grid over the surveys, a degree wider on every side."""
    r = S.extent(surveys(spark, sf_dir), "longitude", "latitude").first()
    return _rounded(G.grid(spark, geo.Box(r["xmin"], r["xmax"], r["ymin"], r["ymax"]).padded(1.0), 20, 20), "x", "y")


@query("SELECT CAST((i % 8 + 1) * 10 AS DOUBLE) AS x, CAST(i // 8 + 1 AS DOUBLE) AS y, vec_id AS t, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS p FROM embeddings, range(64) r(i)")
def raster_long(spark, sf_dir):
    """Vectors as flat arrays of 8 x 8 cells, x fastest, one a time."""
    flat = _read(spark, sf_dir, "embeddings", F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("values"))
    return _rounded(G.raster_long(flat, [10 * k for k in range(1, 9)], list(range(1, 9))), "p")


def _draws(spark, sf_dir):
    rows = G.draws_long(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), ["vec_id", "label"], "embedding")
    return rows.select(F.col("vec_id").alias("pixel"), F.col("label").alias("region"), "draw", X.plogis(4 * F.col("value").cast("double")).alias("p"))


_DRAWS = "d AS (SELECT vec_id AS pixel, label AS region, CAST(i AS INTEGER) AS draw, 1 / (1 + exp(-4 * CAST(embedding[i] AS DOUBLE))) AS p FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


@query(f"WITH {_DRAWS} SELECT pixel, region, draw, round(p, 6) AS p FROM d")
def draws_long(spark, sf_dir):
    return _rounded(_draws(spark, sf_dir), "p")


@query(f"WITH {_DRAWS} SELECT pixel, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_cont(p, 0.975) - quantile_cont(p, 0.025), 6) AS ci_width FROM d GROUP BY pixel")
def posterior_summary(spark, sf_dir):
    return _rounded(R.posterior_summary(_draws(spark, sf_dir), ["pixel"]), "mean", "median", "ci_width")


_EX = ", ".join(f"round(avg(CASE WHEN p > {t} THEN 1.0 ELSE 0.0 END), 6) AS ex_{round(100 * t)}" for t in (0.3, 0.5, 0.7))


@query(f"WITH {_DRAWS} SELECT pixel, {_EX} FROM d GROUP BY pixel")
def exceedance(spark, sf_dir):
    return _rounded(R.exceedance(_draws(spark, sf_dir), ["pixel"], thresholds=(0.3, 0.5, 0.7)), "ex_30", "ex_50", "ex_70")


@query(f"WITH {_DRAWS} SELECT pixel, region, {_EX} FROM d GROUP BY pixel, region")
def exceedance_joined(spark, sf_dir):
    """Three surfaces joined by cell, where they come from different places."""
    out = None
    for t in (0.3, 0.5, 0.7):
        s = R.exceedance_long(_draws(spark, sf_dir), t, f"ex_{round(100 * t)}", ["pixel", "region"])
        out = s if out is None else out.join(s, ["pixel", "region"], "left")
    return _rounded(out, "ex_30", "ex_50", "ex_70")


@query(f"WITH {_DRAWS} SELECT region, draw, round(avg(p), 6) AS mean_p FROM d GROUP BY region, draw")
def region_draw_mean(spark, sf_dir):
    return _rounded(R.region_draw_mean(_draws(spark, sf_dir), ["region", "draw"]), "mean_p")


_REGION = "r AS (SELECT region, draw, avg(p) AS mean_p FROM d GROUP BY region, draw)"


@query(f"WITH {_DRAWS}, {_REGION} SELECT region, round(quantile_cont(mean_p, 0.025), 6) AS lower, round(quantile_cont(mean_p, 0.5), 6) AS mean_prevalence, round(quantile_cont(mean_p, 0.975), 6) AS upper FROM r GROUP BY region")
def region_interval(spark, sf_dir):
    return _rounded(R.region_interval(R.region_draw_mean(_draws(spark, sf_dir), ["region", "draw"]), ["region"]), "lower", "mean_prevalence", "upper")


AREA = X.cell_area_km2((BOX.xmin, BOX.xmax), (BOX.ymin, BOX.ymax), 200, 200)


@query(f"WITH {_DRAWS}, s AS (SELECT pixel, CAST(2012 + pixel % 12 AS INTEGER) AS t, avg(CASE WHEN p > 0.3 THEN 1.0 ELSE 0.0 END) AS ex_30, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) AS ex_50 FROM d GROUP BY pixel), n AS (SELECT t, CAST(count(*) FILTER (ex_30 > 0.8) AS BIGINT) AS n_ex_30, CAST(count(*) FILTER (ex_50 > 0.8) AS BIGINT) AS n_ex_50 FROM s GROUP BY t) SELECT *, round(n_ex_30 * {AREA!r}, 4) AS area_ex_30, round(n_ex_50 * {AREA!r}, 4) AS area_ex_50 FROM n")
def area_over_time(spark, sf_dir):
    s = R.exceedance(_draws(spark, sf_dir), ["pixel"], thresholds=(0.3, 0.5)).withColumn("t", (2012 + F.col("pixel") % 12).cast("int"))
    return _rounded(R.area_over_time(s, AREA, ["t"], ["ex_30", "ex_50"]), "area_ex_30", "area_ex_50", digits=4)


def _regions(spark, sf_dir):
    """Countries as regions: id_1 by nation, with a percent mean a year and marker."""
    return surveys(spark, sf_dir).select(F.col("survey_id").alias("id_1"), F.col("country_name").alias("name_1"), F.col("study_id").alias("name_0"), F.col("year").alias("t"), (F.col("numerator") / F.col("denominator")).alias("p"), "mutation")


_REG = "g AS (SELECT survey_id AS id_1, country_name AS name_1, study_id AS name_0, year AS t, numerator / denominator AS p, mutation FROM obs)"


@query(f"WITH {OBS}, {_REG} SELECT mutation, name_0, t, round(avg(100 * p), 6) AS mean_p, count(*) AS n_cells FROM g GROUP BY ALL")
def admin_year_mean(spark, sf_dir):
    return _rounded(R.admin_year_mean(_regions(spark, sf_dir), ["mutation", "name_0", "t"]), "mean_p")


@query(f"WITH {OBS}, {_REG}, m AS (SELECT mutation, name_0, t, avg(100 * p) AS mean_p FROM g GROUP BY ALL), w AS (SELECT mutation, name_0, max(CASE WHEN t = 2015 THEN mean_p END) AS y_2015, max(CASE WHEN t = 2020 THEN mean_p END) AS y_2020 FROM m GROUP BY ALL) SELECT mutation, name_0, round(y_2015, 6) AS y_2015, round(y_2020, 6) AS y_2020, round((y_2020 - y_2015) / 5 * 100, 4) AS prev_per_year, round((y_2020 - y_2015) / 5, 6) AS percent_per_year FROM w")
def prev_per_year_pivot(spark, sf_dir):
    wide = R.prevalence_per_year(R.admin_year_mean(_regions(spark, sf_dir), ["mutation", "name_0", "t"]), ["mutation", "name_0"], 2015, 2020)
    return _rounded(_rounded(wide, "y_2015", "y_2020", "percent_per_year"), "prev_per_year", digits=4)


@query(f"WITH {OBS}, {_REG} SELECT g.id_1, t, mutation, round(p, 6) AS p, n_name AS region_name FROM g LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS id_1, n_name FROM nation) n USING (id_1)")
def region_lookup_join(spark, sf_dir):
    lookup = _read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("string").alias("id_1"), F.col("n_name").alias("region_name"))
    return _rounded(R.lookup_join(_regions(spark, sf_dir).select("id_1", "t", "mutation", "p"), lookup, "id_1", ["region_name"]), "p")


@query(f"WITH {OBS}, {_REG} SELECT DISTINCT id_1 FROM g WHERE id_1 NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey < 3)")
def missing_regions(spark, sf_dir):
    lookup = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("id_1"))
    return R.missing(_regions(spark, sf_dir), lookup, "id_1")


@query(f"WITH {OBS}, {_REG} SELECT id_1, mutation, t, round(p, 6) AS p FROM g WHERE (id_1, mutation) IN (SELECT (id_1, mutation) FROM g WHERE p > 0.4)")
def groups_ever_above_cutoff(spark, sf_dir):
    return _rounded(R_ever(spark, sf_dir), "p")


def R_ever(spark, sf_dir):
    return O.ever_above(_regions(spark, sf_dir), ["id_1", "mutation"], "p", 0.4).select("id_1", "mutation", "t", "p")


@query(f"WITH {OBS} SELECT survey_id, mutation, year, round(prevalence, 6) AS prevalence FROM obs WHERE mutation IN (SELECT mutation FROM obs WHERE prevalence > 44)")
def mutations_with_positives(spark, sf_dir):
    rows = surveys(spark, sf_dir).withColumn("above", F.col("prevalence") - 44)
    return _rounded(O.with_positives(rows, "above").select("survey_id", "mutation", "year", "prevalence"), "prevalence")


_PEAK = "k AS (SELECT *, row_number() OVER (PARTITION BY mutation, t ORDER BY p DESC, name_0, name_1) AS k FROM g)"


@query(f"WITH {OBS}, {_REG}, {_PEAK} SELECT mutation, t, round(p, 6) AS p, name_0, name_1, id_1 FROM k WHERE k = 1")
def peak_region_per_year(spark, sf_dir):
    return _rounded(R.peak(_regions(spark, sf_dir), ["mutation", "t"], "p", ["name_0", "name_1"]), "p")


@query(f"WITH {OBS}, {_REG}, l AS (SELECT *, rank() OVER (PARTITION BY name_0, name_1 ORDER BY t DESC) AS k FROM g) SELECT name_0, name_1, mutation, t, round(p, 6) AS p FROM l WHERE k = 1")
def last_point_per_region(spark, sf_dir):
    return _rounded(R.last_point(_regions(spark, sf_dir), ["name_0", "name_1"]), "p").select("name_0", "name_1", "mutation", "t", "p")


@query(f"WITH {OBS}, {_REG}, {_PEAK}, q AS (SELECT DISTINCT mutation, name_0, name_1 FROM k WHERE k = 1 AND t IN (2015, 2020)), w AS (SELECT g.mutation, g.name_0, g.name_1, max(CASE WHEN t = 2015 THEN p END) AS a, max(CASE WHEN t = 2020 THEN p END) AS b, max(CASE WHEN t = 2015 THEN p / 2 END) AS c, max(CASE WHEN t = 2020 THEN p / 2 END) AS e FROM g JOIN q USING (mutation, name_0, name_1) GROUP BY ALL) SELECT mutation, name_0, name_1, round(a, 6) AS mean_prevalence_y_2015, round(b, 6) AS mean_prevalence_y_2020, round(c, 6) AS lower_y_2015, round(e, 6) AS lower_y_2020, round((b - a) / 5, 6) AS rate_change_per_year FROM w")
def peak_regions_wide(spark, sf_dir):
    rows = _regions(spark, sf_dir).select("mutation", "name_0", "name_1", "t", F.col("p").alias("mean_prevalence"), (F.col("p") / 2).alias("lower"))
    top = R.peak(rows, ["mutation", "t"], "mean_prevalence", ["name_0", "name_1"]).filter(F.col("t").isin(2015, 2020))
    top = top.select("mutation", F.col("name_0").alias("admin0"), F.col("name_1").alias("admin1")).distinct()
    met = rows.join(top.withColumnRenamed("mutation", "m"), (F.col("mutation") == F.col("m")) & (F.col("name_0") == F.col("admin0")) & (F.col("name_1") == F.col("admin1")))
    wide = G.pivot_years(met, ["mutation", "name_0", "name_1"], "t", [2015, 2020], ["mean_prevalence", "lower"])
    wide = wide.withColumn("rate_change_per_year", G.yearly_rate(F.col("mean_prevalence_y_2015"), F.col("mean_prevalence_y_2020"), 5))
    return _rounded(wide, *[c for c in wide.columns if "_y_" in c], "rate_change_per_year")


def _placed(spark, sf_dir):
    """Surveys with a logit, an id and kilometres around a fixed centre."""
    rows = O.with_logit(O.valid_counts(surveys(spark, sf_dir))).withColumn("id", F.col("survey_id").cast("long"))
    x, y = geo.laea_km(F.col("longitude"), F.col("latitude"), 35.0, 5.0)
    return rows.withColumn("x_km", x).withColumn("y_km", y).withColumn("day", X.midyear(F.col("year")))


def _laea_sql(lon: str, lat: str, lon0: float, lat0: float) -> tuple[str, str]:
    e2, e, qp = geo.E2, geo.ECC, geo._q(1.0)
    s = f"sin(radians({lat}))"
    beta = f"asin(({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r})) / {qp!r})"
    phi0 = math.radians(lat0)
    beta0 = math.asin(geo._q(math.sin(phi0)) / qp)
    rq = geo.A * math.sqrt(qp / 2)
    d = geo.A * math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2) / (rq * math.cos(beta0))
    turn = f"radians({lon} - {lon0!r})"
    b = f"({rq!r} * sqrt(2 / (1 + {math.sin(beta0)!r} * sin({beta}) + {math.cos(beta0)!r} * cos({beta}) * cos({turn}))))"
    return f"({b} * {d!r} * cos({beta}) * sin({turn}) / 1000)", f"({b} / {d!r} * ({math.cos(beta0)!r} * sin({beta}) - {math.sin(beta0)!r} * cos({beta}) * cos({turn})) / 1000)"


_X, _Y = _laea_sql("longitude", "latitude", 35.0, 5.0)
_PLACED = f"a AS (SELECT CAST(survey_id AS BIGINT) AS id, mutation, year, longitude, latitude, {_X} AS x_km, {_Y} AS y_km, {LOGIT} AS z FROM obs WHERE denominator > 0)"
_DIST = "sqrt((a.x_km - b.x_km) ** 2 + (a.y_km - b.y_km) ** 2)"


@query(f"WITH {OBS}, {_PLACED} SELECT DISTINCT longitude, latitude, round(x_km, 6) AS x_km, round(y_km, 6) AS y_km FROM a")
def laea_xy(spark, sf_dir):
    return _rounded(_placed(spark, sf_dir).select("longitude", "latitude", "x_km", "y_km").distinct(), "x_km", "y_km")


@query(f"WITH {OBS} SELECT DISTINCT longitude, latitude, round({geo.A} * radians(longitude), 3) AS x_m, round({geo.A} * ln(tan(pi() / 4 + radians(latitude) / 2)), 3) + 0.0 AS y_m FROM obs")
def mercator_xy(spark, sf_dir):
    x, y = geo.mercator(F.col("longitude"), F.col("latitude"))
    return surveys(spark, sf_dir).select("longitude", "latitude", F.round(x, 3).alias("x_m"), (F.round(y, 3) + 0.0).alias("y_m")).distinct()


_R = geo.A


@query(f"WITH {OBS}, m AS (SELECT min({_R} * radians(longitude)) - 200000 AS x1, max({_R} * radians(longitude)) + 200000 AS x2, min({_R} * ln(tan(pi() / 4 + radians(latitude) / 2))) - 200000 AS y1, max({_R} * ln(tan(pi() / 4 + radians(latitude) / 2))) + 200000 AS y2 FROM obs) SELECT round(degrees(x1 / {_R}), 6) AS xmin, round(degrees(x2 / {_R}), 6) AS xmax, round(degrees(2 * atan(exp(y1 / {_R})) - pi() / 2), 6) AS ymin, round(degrees(2 * atan(exp(y2 / {_R})) - pi() / 2), 6) AS ymax FROM m")
def extent_buffered(spark, sf_dir):
    x, y = geo.mercator(F.col("longitude"), F.col("latitude"))
    e = S.extent(surveys(spark, sf_dir).select(x.alias("x"), y.alias("y")), "x", "y")
    lo, hi = geo.from_mercator(F.col("xmin") - 200_000, F.col("ymin") - 200_000), geo.from_mercator(F.col("xmax") + 200_000, F.col("ymax") + 200_000)
    return e.select(*[F.round(c, 6).alias(n) for c, n in zip((lo[0], hi[0], lo[1], hi[1]), ("xmin", "xmax", "ymin", "ymax"))])


@query(f"WITH {OBS}, {_PLACED} SELECT a.mutation, a.id AS id1, b.id AS id2, a.year, round({_DIST}, 6) AS dist, round(b.z - a.z, 6) AS dz FROM a JOIN a b ON b.year = a.year + 1 AND a.mutation = b.mutation WHERE {_DIST} <= 600")
def pairs_one_year(spark, sf_dir):
    return _rounded(P.one_year_pairs(_placed(spark, sf_dir), 600.0), "dist", "dz")


@query(f"WITH {OBS}, {_PLACED} SELECT a.mutation, round(avg((b.z - a.z) ** 2), 6) AS tau2_year, count(b.z - a.z) AS n_pairs FROM a JOIN a b ON b.year = a.year + 1 AND a.mutation = b.mutation WHERE {_DIST} <= 600 GROUP BY a.mutation")
def tau2(spark, sf_dir):
    return _rounded(P.tau2_near(_placed(spark, sf_dir), 600.0), "tau2_year")


@query(f"WITH {OBS}, {_PLACED} SELECT round(avg((b.z - a.z) ** 2), 6) AS tau2_year, count(b.z - a.z) AS n_pairs FROM (SELECT * FROM a WHERE mutation IN ('crt:76:T', 'mdr1:86:Y')) a JOIN (SELECT * FROM a WHERE mutation IN ('crt:76:T', 'mdr1:86:Y')) b ON b.year = a.year + 1 WHERE {_DIST} <= 600")
def tau2_pooled(spark, sf_dir):
    rows = _placed(spark, sf_dir).filter(F.col("mutation").isin("crt:76:T", "mdr1:86:Y"))
    return _rounded(P.tau2_near(rows, 600.0, by=()), "tau2_year")


_VAR = f"v AS (SELECT a.mutation, {_DIST} AS d, a.z - b.z AS dz FROM (SELECT *, make_date(year, 7, 1) AS day FROM a) a JOIN (SELECT *, make_date(year, 7, 1) AS day FROM a) b ON b.day = a.day + 365 AND a.mutation = b.mutation)"
_BINS = "n AS (SELECT mutation, CAST(floor(d / 25) AS BIGINT) AS bin, avg(d) AS dist, avg(dz ** 2) / 2 AS gamma, count(*) AS np FROM v WHERE dz IS NOT NULL GROUP BY ALL)"


@query(f"WITH {OBS}, {_PLACED}, {_VAR}, {_BINS} SELECT mutation, bin, round(dist, 6) AS dist, round(gamma, 6) AS gamma, np FROM n")
def variogram_bins(spark, sf_dir):
    return _rounded(P.variogram_bins(_placed(spark, sf_dir)), "dist", "gamma")


@query(f"WITH {OBS}, {_PLACED}, {_VAR}, {_BINS.replace('dz IS NOT NULL', 'dz IS NOT NULL AND d <= 700')} SELECT mutation, bin, round(dist, 6) AS dist, round(gamma, 6) AS gamma, np FROM n")
def variogram_bins_near(spark, sf_dir):
    """Bins up to a cutoff, whose pairs meet on cells of its size."""
    return _rounded(P.variogram_bins(_placed(spark, sf_dir), cutoff_km=700.0), "dist", "gamma")


@query(f"WITH {OBS}, {_PLACED}, {_VAR}, {_BINS} SELECT mutation, round(sum(sqrt(np) * (gamma - (0.8 + 0.5 * (1 - exp(-((dist / 400.0) ** 2))))) ** 2), 5) AS loss FROM n WHERE dist > 0 GROUP BY mutation")
def variogram_loss(spark, sf_dir):
    return _rounded(variogram.weighted_loss(P.variogram_bins(_placed(spark, sf_dir)), 0.5, 400.0), "loss", digits=5)


@query(f"WITH {OBS}, {_PLACED}, {_VAR}, {_BINS}, c AS (SELECT mutation, i * (max(dist) / 499) AS dist FROM n, range(500) r(i) GROUP BY mutation, i) SELECT mutation, round(dist, 6) AS dist, round(0.8 + 0.5 * (1 - exp(-((dist / 400.0) ** 2))), 6) AS gamma FROM c")
def variogram_curve(spark, sf_dir):
    """A curve for each marker, up to its farthest bin."""
    far = P.variogram_bins(_placed(spark, sf_dir)).groupBy("mutation").agg(F.max("dist").alias("far"))
    return _rounded(variogram.curves(far, 0.5, 400.0), "dist", "gamma")


#: All pairs of surveys of a marker; a survey's number is its row by marker, year and nation.
_ALL = f"r AS (SELECT *, row_number() OVER (ORDER BY mutation, year, id) AS row FROM a), p AS (SELECT a.mutation, a.row AS ind1, b.row AS ind2, {_DIST} AS dist_space, CAST(abs(a.year - b.year) AS INTEGER) AS dist_time, a.z - b.z AS dist_z FROM r a JOIN r b ON a.mutation = b.mutation AND a.row > b.row)"


def _pairs(spark, sf_dir):
    rows = _placed(spark, sf_dir).select("mutation", "year", F.col("id").alias("survey"), F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.col("year").alias("t"), "z")
    return P.pair_distances(G.with_row_number(rows, ["mutation", "year", "survey"]), ["mutation"])


@query(f"WITH {OBS}, {_PLACED}, {_ALL} SELECT mutation, ind1, ind2, round(dist_space, 6) AS dist_space, dist_time, round(dist_z, 6) AS dist_z FROM p")
def pair_distances(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir), "dist_space", "dist_z")


@query(f"WITH {OBS}, {_PLACED}, {_ALL} SELECT mutation, ind1, ind2, round(exp(-((dist_space / 300.0) ** 1)) * exp(-((dist_time / 2.0) ** 2)), 6) AS cor FROM p")
def vario_cor(spark, sf_dir):
    return _pairs(spark, sf_dir).select("mutation", "ind1", "ind2", F.round(X.vario_cor(F.col("dist_space"), F.col("dist_time"), 300.0, 2.0), 6).alias("cor"))


@query(f"WITH {OBS}, {_PLACED}, {_ALL}, c AS (SELECT *, 0.1 + 0.9 * (1 - exp(-(dist_space / 300.0)) * exp(-((dist_time / 2.0) ** 2))) AS c FROM p) SELECT mutation, round(sum(-0.5 * (ln(2 * pi() * c) + dist_z ** 2 / c)), 4) AS loglike, count(dist_z) AS n_pairs FROM c GROUP BY mutation")
def vario_loglike(spark, sf_dir):
    rows = _placed(spark, sf_dir).select("mutation", F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.col("year").alias("t"), "z")
    return _rounded(P.loglike_of_blocks(rows, 300.0, 2.0, 0.1, 0.9, ["mutation"]), "loglike", digits=4)


def rectangles(spark) -> DataFrame:
    """Four rectangles, two with a shared border, as polygons."""
    ring = lambda a, b, c, d: "array(" + ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for x, y in ((a, c), (b, c), (b, d), (a, d), (a, c))) + ")"
    rows = " UNION ALL ".join(f"SELECT '{i}' AS id_1, '{n}' AS name_1, array({ring(*r)}) AS rings" for i, (n, r) in enumerate(RECTANGLES.items()))
    return spark.sql(rows)


RECTANGLES = {"west": (26, 35, -6, 6), "east": (35, 44, -6, 6), "north": (30, 40, 9, 16), "empty": (-10, -5, 0, 5)}
_RECT = "rect(id_1, name_1, x1, x2, y1, y2) AS (VALUES " + ", ".join(f"('{i}', '{n}', {a}, {b}, {c}, {d})" for i, (n, (a, b, c, d)) in enumerate(RECTANGLES.items())) + ")"


@query(f"WITH {OBS}, {_LONG}, {_RECT} SELECT x, y, t, mutation, round(p, 6) AS p, id_1, name_1 FROM l JOIN rect ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
def spatial_join_rect(spark, sf_dir):
    return _rounded(S.spatial_join(_long(spark, sf_dir), rectangles(spark), ["id_1", "name_1"], rectangles=True), "p").select("x", "y", "t", "mutation", "p", "id_1", "name_1")


@query(f"WITH {OBS}, {_LONG}, {_RECT} SELECT x, y, t, mutation, id_1, name_1 FROM l LEFT JOIN rect ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
def spatial_join_left(spark, sf_dir):
    """The general path: exact test on Arrow batches, unmatched points kept."""
    return S.spatial_join(_long(spark, sf_dir), rectangles(spark), ["id_1", "name_1"], how="left").select("x", "y", "t", "mutation", "id_1", "name_1")


#: A horseshoe, a square with a hole, and a triangle that overlaps both; no survey lies on an edge.
SHAPES = {
    "horseshoe": [[(25.5, -6.5), (38.5, -6.5), (38.5, 12.5), (32.5, 12.5), (32.5, -1.5), (29.5, -1.5), (29.5, 12.5), (25.5, 12.5)]],
    "ring": [[(33.2, -5.7), (44.6, -5.7), (44.6, 16.3), (33.2, 16.3)], [(37.1, 2.3), (41.7, 2.3), (41.7, 11.9), (37.1, 11.9)]],
    "wedge": [[(26.3, 17.2), (45.1, 9.7), (30.9, -7.4)]],
}
_EDGES = "edge(id_1, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"('{i}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, rings in SHAPES.items() for r in rings for a, b in zip(r, [*r[1:], r[0]])) + ")"


def shapes(spark) -> DataFrame:
    """Polygons that aren't their own bounding boxes: concave, with a hole, overlapping."""
    return spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in SHAPES.items()], "id_1 string, rings array<array<struct<x: double, y: double>>>")


@query(f"WITH {OBS}, {_LONG}, {_EDGES}, spot AS (SELECT DISTINCT x, y FROM l), h AS (SELECT x, y, id_1 FROM spot CROSS JOIN edge GROUP BY x, y, id_1 HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1) SELECT x, y, t, mutation, id_1 FROM l LEFT JOIN h USING (x, y)")
def spatial_join_shapes(spark, sf_dir):
    """Even-odd test against concave polygons and holes; points may lie in several, or in none."""
    return S.spatial_join(_long(spark, sf_dir), shapes(spark), ["id_1"], how="left").select("x", "y", "t", "mutation", "id_1")


@query(f"WITH {OBS}, {_LONG}, {_RECT} SELECT x, y, t, mutation, CASE WHEN EXISTS (SELECT 1 FROM rect WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2) THEN round(p, 6) END AS p FROM l")
def mask_rect(spark, sf_dir):
    return _rounded(S.mask(_long(spark, sf_dir), rectangles(spark)), "p").select("x", "y", "t", "mutation", "p")


@query(f"WITH {OBS}, a AS (SELECT survey_id, year, mutation, denominator AS n, {LOGIT} AS z FROM obs) SELECT survey_id, year, mutation, round(CASE WHEN z IS NULL OR abs(z) < 1e-6 THEN n / 4 ELSE 0.5 * n / abs(z) * (exp(abs(z)) - 1) / (exp(abs(z)) + 1) END, 6) AS w FROM a")
def pg_weights(spark, sf_dir):
    """The weights that the model uses; the column form of the same formula is exprs.pg_weight."""
    rows = O.with_logit(surveys(spark, sf_dir)).select("survey_id", "year", "mutation", "denominator", "z")

    def run(batches):
        for b in batches:
            w = kalman.pg_weights(b["denominator"].to_numpy(float), b["z"].to_numpy(float))
            yield b[["survey_id", "year", "mutation"]].assign(w=w)

    return _rounded(rows.mapInPandas(run, "survey_id string, year int, mutation string, w double"), "w")


_FEATURES = ", ".join([f"round({f}({wx} * x_km + {wy} * y_km) / sqrt({len(OMEGA)}), 6) AS {f}_{i}" for f in ("cos", "sin") for i, (wx, wy) in enumerate(OMEGA)])


@query(f"WITH {OBS}, {_PLACED} SELECT DISTINCT id, {_FEATURES} FROM a")
def rff_features_small(spark, sf_dir):
    names = [f"{f}_{i}" for f in ("cos", "sin") for i in range(len(OMEGA))]

    def run(batches):
        for b in batches:
            phi = rff.features(b[["x_km", "y_km"]].to_numpy(float), np.array(OMEGA))
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(phi, columns=names)], axis=1)

    rows = _placed(spark, sf_dir).select("id", "x_km", "y_km").distinct()
    return _rounded(rows.mapInPandas(run, "id long, " + ", ".join(f"{n} double" for n in names)), *names)


@query(f"WITH {OBS} SELECT median(longitude) AS lon0, median(latitude) AS lat0, round(median(numerator / denominator), 6) AS p_mid, min(year) AS first_year, max(year) AS last_year, bool_or(numerator > denominator) AS any_over, bool_and(denominator > 0) AS all_positive, count(DISTINCT mutation) AS n_mutations FROM obs")
def survey_summary(spark, sf_dir):
    """Medians by refined histograms; extent, any and all, distinct counts in one pass."""
    rows = stored(surveys(spark, sf_dir).withColumn("p", F.col("numerator") / F.col("denominator")), "surveys")
    lon, lat, p = (F.lit(exact_quantile(rows, c)).cast("double") for c in ("longitude", "latitude", "p"))
    return rows.agg(
        F.max(lon).alias("lon0"), F.max(lat).alias("lat0"), F.round(F.max(p), 6).alias("p_mid"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.bool_or(F.col("numerator") > F.col("denominator")).alias("any_over"),
        F.bool_and(F.col("denominator") > 0).alias("all_positive"), F.count_distinct("mutation").alias("n_mutations"))


@query(f"WITH {OBS} SELECT survey_id, mutation, year FROM obs WHERE country_name NOT IN ('FRANCE', 'GERMANY') AND NOT (country_name = 'KENYA' AND mutation IN ('crt:76:T'))")
def exclusions(spark, sf_dir):
    rows = O.not_in(surveys(spark, sf_dir), "country_name", ["FRANCE", "GERMANY"])
    return O.excluding(rows, [("KENYA", ["crt:76:T"])], "country_name").select("survey_id", "mutation", "year")


@query(f"WITH {OBS}, {COMBINED} SELECT DISTINCT mutation, year, CAST(CASE WHEN mutation = 'k13:comb' THEN make_date(year, 7, 1) ELSE make_date(year, 3, 15) END AS VARCHAR) AS day FROM com")
def survey_days(spark, sf_dir):
    day = X.survey_day(F.col("mutation"), F.col("year"), F.make_date("year", F.lit(3), F.lit(15)))
    return combined(spark, sf_dir).select("mutation", "year", day.cast("string").alias("day")).distinct()


@query(f"WITH {OBS} SELECT row_number() OVER (ORDER BY mutation, year, CAST(survey_id AS BIGINT)) AS id, mutation, year, CAST(survey_id AS BIGINT) AS survey FROM obs")
def row_numbers(spark, sf_dir):
    return G.with_row_number(surveys(spark, sf_dir).select("mutation", "year", F.col("survey_id").cast("long").alias("survey")), ["mutation", "year", "survey"])


@query(f"WITH {OBS} SELECT survey_id, mutation, year, round(prevalence, 6) AS prevalence FROM obs ORDER BY prevalence DESC, mutation, survey_id, year LIMIT 20")
def top_rows(spark, sf_dir):
    rows = surveys(spark, sf_dir).orderBy(F.col("prevalence").desc(), "mutation", "survey_id", "year").limit(20)
    return _rounded(rows.select("survey_id", "mutation", "year", "prevalence"), "prevalence")


@query(f"WITH {OBS} SELECT DISTINCT country_name, CASE country_name WHEN 'KENYA' THEN '#1b9e77' WHEN 'ETHIOPIA' THEN '#d95f02' END AS colour FROM obs")
def country_colours(spark, sf_dir):
    return surveys(spark, sf_dir).select("country_name", R.named(F.col("country_name"), {"KENYA": "#1b9e77", "ETHIOPIA": "#d95f02"}).alias("colour")).distinct()


@query(f"WITH {OBS} SELECT count(*) FILTER (denominator <= 0) = 0 AS denominator, bool_and(numerator >= 0) AS numerator, bool_and(year BETWEEN 1995 AND 2025) AS year, bool_and(longitude BETWEEN -180 AND 180) AS longitude, bool_and(prevalence <= 50) AS prevalence FROM obs")
def column_checks(spark, sf_dir):
    rules = {"denominator": V.column_rules(low=1e-9, required=True), "numerator": V.column_rules(low=0, whole=True), "year": V.column_rules(1995, 2025, required=True), "longitude": V.column_rules(-180, 180), "prevalence": V.column_rules(high=50)}
    return V.check_columns(surveys(spark, sf_dir), rules)


@query("SELECT label AS t, CAST(i // 8 AS INTEGER) AS iy, CAST(i % 8 AS INTEGER) AS ix, CAST(vec_id AS INTEGER) AS draw, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS p FROM embeddings, range(64) r(i) WHERE label IN (2, 3, 7) AND i // 8 BETWEEN 2 AND 6 AND i % 8 BETWEEN 3 AND 4 AND vec_id BETWEEN 100 AND 1500")
def array_slice(spark, sf_dir):
    """A slice of times, window and draws of an array of vectors (label, 8 x 8 cells, vector), kept in chunks."""
    long = G.draws_long(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), ["vec_id", "label"], "embedding")
    cell = (F.col("draw") - 1).cast("int")
    path = f"{shared.folder(spark)}/array-{uuid.uuid4().hex}"
    A.write_array(long.select(F.col("label").alias("t"), F.floor(cell / 8).cast("int").alias("iy"), (cell % 8).alias("ix"), F.col("vec_id").cast("int").alias("draw"), F.col("value").alias("p")), path, chunk=(4, 4, 256))
    return _rounded(A.read_array(spark, path, [2, 3, 7], (2, 6), (3, 4), (100, 1500), chunk=(4, 4, 256)), "p")


def _order_sql(column: str, order: str) -> str:
    return (f"SELECT '{column}' AS rule, coalesce(bool_and(v >= coalesce(b, v)), true) AS increasing, coalesce(bool_and(v <= coalesce(b, v)), true) AS decreasing, (SELECT count(DISTINCT {column}) = count(*) FROM obs) AS noduplicates"
            f" FROM (SELECT {column} AS v, lag({column}) OVER (ORDER BY {order}) AS b FROM obs)")


@query(f"WITH {OBS} {_order_sql('year', 'year, mutation, survey_id')} UNION ALL {_order_sql('latitude', 'latitude DESC, mutation, survey_id, year').replace(chr(39) + 'latitude' + chr(39), chr(39) + 'south' + chr(39))} UNION ALL {_order_sql('prevalence', 'mutation, year, survey_id')}")
def order_checks(spark, sf_dir):
    """Whether columns increase, decrease or repeat, in an order that other columns give."""
    rows = stored(surveys(spark, sf_dir).withColumn("up", -F.col("latitude")), "surveys")
    checks = {"year": V.check_order(rows, "year", ["year", "mutation", "survey_id"]), "south": V.check_order(rows, "latitude", ["up", "mutation", "survey_id", "year"]), "prevalence": V.check_order(rows, "prevalence", ["mutation", "year", "survey_id"])}
    out = None
    for name, one in checks.items():
        one = one.select(F.lit(name).alias("rule"), "increasing", "decreasing", "noduplicates")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(date_trunc('week', ts) AS VARCHAR)[:10] AS week, event_type, count(*) AS n, round(avg(value), 5) AS mean_value FROM events GROUP BY ALL")
def event_weeks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean_value"))


@query(f"WITH {OBS}, {_LONG} SELECT x, y, t, mutation, round(100 * p, 6) AS fill FROM l")
def map_layers(spark, sf_dir):
    layers = R.map_layers(_long(spark, sf_dir), None, 5.0, 5.0)
    return _rounded(layers["raster"], "fill").select("x", "y", "t", "mutation", "fill")


HYPER = "SELECT mutation, CAST(600 AS DOUBLE) AS ell_km, CAST(0.05 AS DOUBLE) AS tau2_year FROM VALUES " + ", ".join(f"('{m}')" for m in MUTATIONS) + " AS v(mutation)"


def _settings(rows: DataFrame) -> model.Settings:
    """The default settings, from the first to the last year that has surveys."""
    r = rows.agg(F.min("year"), F.max("year")).first()
    return model.Settings(first_year=r[0], last_year=r[1])


def _fits(spark, sf_dir) -> tuple[DataFrame, model.Settings]:
    rows = _placed(spark, sf_dir)
    s = _settings(rows)
    return model.fit_models(rows, spark.sql(HYPER), s), s


@query()
def kalman_smooth(spark, sf_dir):
    """Posterior weights by mutation, year and weight (numbered from 1): mean and spread over draws."""
    fits, s = _fits(spark, sf_dir)

    def run(batches):
        for b in batches:
            for mutation, t, weights in zip(b["mutation"], b["t"], b["weights"]):
                w = np.asarray(weights, float).reshape(2 * s.features, s.draws)
                yield pd.DataFrame({"mutation": mutation, "t": t, "weight": np.arange(1, len(w) + 1), "mean_weight": w.mean(1), "sd_weight": w.std(1, ddof=1)})

    return fits.mapInPandas(run, "mutation string, t int, weight int, mean_weight double, sd_weight double")


def _cells(spark, s: model.Settings):
    cells = model.prediction_cells(spark, BOX, s, (35.0, 5.0)).drop("id_1")
    return S.spatial_join(cells, rectangles(spark), ["id_1"], how="left", rectangles=True)


@query()
def posterior_surface(spark, sf_dir):
    fits, s = _fits(spark, sf_dir)
    return model.surface(fits, model.prediction_cells(spark, BOX, s, (35.0, 5.0)), s)


@query()
def region_series(spark, sf_dir):
    """Interval of the regional mean by mutation, region and year."""
    fits, s = _fits(spark, sf_dir)
    return R.region_interval(model.region_draws(fits, _cells(spark, s), s), ["mutation", "id_1", "t"])


@query()
def region_series_fitted(spark, sf_dir):
    """The chain of the jobs: variogram and tau squared of every marker, the fit with them, intervals of regional means."""
    rows = _placed(spark, sf_dir)
    s = _settings(rows)
    hyper = variogram.hyperparameters(rows, 600.0).select("mutation", "ell_km", "tau2_year")
    return R.region_interval(model.region_draws(model.fit_models(rows, hyper, s), _cells(spark, s), s), ["mutation", "id_1", "t"])


#: One frequency, so a state of two weights, whose filter and smoother SQL can follow survey by survey.
EXACT = model.Settings(features=1, rounds=5, nx=12, ny=10)
EXACT_ELL, EXACT_TAU2 = 600.0, 0.05


def _exact_sql() -> str:
    """All rounds of EM: places with their features, then a recursion over updates and one back over years in each round."""
    wx, wy = map(float, rff.frequencies(1, EXACT_ELL, EXACT.seed)[0])
    z0, tau = kalman.Z0, EXACT_TAU2
    parts = [
        f"pl AS (SELECT mutation, year, {_X} AS x_km, {_Y} AS y_km, sum(numerator) AS y, sum(denominator) AS n FROM obs WHERE denominator > 0 GROUP BY mutation, year, longitude, latitude)",
        f"st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mutation ORDER BY year, kind, x_km, y_km) AS step FROM (SELECT mutation, year, 1 AS kind, x_km, y_km, y, n, cos({wx!r} * x_km + {wy!r} * y_km) AS f1, sin({wx!r} * x_km + {wy!r} * y_km) AS f2 FROM pl"
        " UNION ALL SELECT m.mutation, s.year, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT mutation FROM pl) m, (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM pl) s))",
        "e AS MATERIALIZED (SELECT mutation, year, max(step) AS step FROM st GROUP BY ALL)",
        "b0 AS (SELECT mutation, year, CAST(0 AS DOUBLE) AS m1, CAST(0 AS DOUBLE) AS m2 FROM e)",
    ]
    for r in range(1, EXACT.rounds + 1):
        eta = f"({z0!r} + f1 * m1 + f2 * m2)"
        w = f"greatest(CASE WHEN abs({eta}) >= 1e-6 THEN 0.5 * n / abs({eta}) * (exp(abs({eta})) - 1) / (exp(abs({eta})) + 1) ELSE n / 4 END, 1e-10)"
        parts += [
            f"u{r} AS MATERIALIZED (SELECT mutation, year, step, kind, f1, f2, w, (y - n / 2) / w - {z0!r} AS z FROM (SELECT *, {w} AS w FROM st JOIN b{r - 1} USING (mutation, year)))",
            f"f{r} AS (SELECT DISTINCT mutation, CAST(0 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS m1, CAST(0 AS DOUBLE) AS m2, CAST(0 AS DOUBLE) AS c11, CAST(0 AS DOUBLE) AS c12, CAST(0 AS DOUBLE) AS c22 FROM e UNION ALL"
            f" SELECT mutation, step, CASE kind WHEN 0 THEN m1 ELSE m1 + g1 * miss / s END, CASE kind WHEN 0 THEN m2 ELSE m2 + g2 * miss / s END,"
            f" CASE kind WHEN 0 THEN c11 + {tau} ELSE c11 - g1 * g1 / s END, CASE kind WHEN 0 THEN c12 ELSE c12 - g1 * g2 / s END, CASE kind WHEN 0 THEN c22 + {tau} ELSE c22 - g2 * g2 / s END"
            f" FROM (SELECT f.*, u.step AS next, kind, c11 * f1 + c12 * f2 AS g1, c12 * f1 + c22 * f2 AS g2, f1 * (c11 * f1 + c12 * f2) + f2 * (c12 * f1 + c22 * f2) + 1 / w AS s, z - f1 * m1 - f2 * m2 AS miss FROM f{r} f JOIN u{r} u ON u.mutation = f.mutation AND u.step = f.step + 1) t(mutation, before, m1, m2, c11, c12, c22, step, kind, g1, g2, s, miss))",
            f"k{r} AS MATERIALIZED (SELECT mutation, year, m1, m2, c11, c12, c22 FROM f{r} JOIN e USING (mutation, step))",
            f"b{r} AS (SELECT * FROM k{r} WHERE year = (SELECT max(year) FROM e) UNION ALL"
            f" SELECT mutation, year, m1 + j11 * d1 + j12 * d2, m2 + j21 * d1 + j22 * d2, c11 + j11 * (j11 * d11 + j12 * d12) + j12 * (j11 * d12 + j12 * d22),"
            f" c12 + j21 * (j11 * d11 + j12 * d12) + j22 * (j11 * d12 + j12 * d22), c22 + j21 * (j21 * d11 + j22 * d12) + j22 * (j21 * d12 + j22 * d22)"
            f" FROM (SELECT k.*, b.m1 - k.m1 AS d1, b.m2 - k.m2 AS d2, b.c11 - k.c11 - {tau} AS d11, b.c12 - k.c12 AS d12, b.c22 - k.c22 - {tau} AS d22,"
            f" (k.c11 * (k.c22 + {tau}) - k.c12 * k.c12) / det AS j11, (k.c12 * (k.c11 + {tau}) - k.c11 * k.c12) / det AS j12,"
            f" (k.c12 * (k.c22 + {tau}) - k.c22 * k.c12) / det AS j21, (k.c22 * (k.c11 + {tau}) - k.c12 * k.c12) / det AS j22"
            f" FROM (SELECT *, (c11 + {tau}) * (c22 + {tau}) - c12 * c12 AS det FROM k{r}) k JOIN b{r} b ON b.mutation = k.mutation AND b.year = k.year + 1))",
        ]
    return ", ".join(parts)


_EM = _exact_sql()


def _smoothed(spark, sf_dir) -> tuple[DataFrame, model.Settings]:
    rows = _placed(spark, sf_dir)
    s = dataclasses.replace(EXACT, **{k: getattr(_settings(rows), k) for k in ("first_year", "last_year")})
    hyper = rows.select("mutation", F.lit(EXACT_ELL).alias("ell_km"), F.lit(EXACT_TAU2).alias("tau2_year")).distinct()
    return model.smoothed(rows, hyper, s), s


@query(f"WITH RECURSIVE {OBS}, {_EM} SELECT mutation, CAST(year AS INTEGER) AS t, round(m1, 5) AS m1, round(m2, 5) AS m2, round(c11, 6) AS c11, round(c12, 6) AS c12, round(c22, 6) AS c22 FROM b{EXACT.rounds}")
def kalman_exact(spark, sf_dir):
    """Smoothed weights and covariances after all rounds of EM, for one frequency, over all surveys."""
    out, _ = _smoothed(spark, sf_dir)
    return out.select("mutation", "t", *[F.round(F.col("mean")[i], 5).alias(f"m{i + 1}") for i in range(2)], *[F.round(F.col("cov")[i], 6).alias(n) for i, n in ((0, "c11"), (1, "c12"), (3, "c22"))])


#: Posterior paths on normal numbers that a formula gives.
PATHS = dataclasses.replace(EXACT, draws=9)


def _noise(year: int, weights: int, draws: int) -> np.ndarray:
    return 1.5 * np.sin(1.3 * np.arange(weights)[:, None] + 0.7 * np.arange(draws) + 0.11 * (year - 2000))


def _paths_sql() -> str:
    """Backwards over the years from the last round's filter: gain, conditional covariance and its lower root, for two weights."""
    tau, top = EXACT_TAU2, f"k{EXACT.rounds}"
    noise = lambda k, y: f"1.5 * sin({1.3 * k} + 0.7 * d + 0.11 * ({y} - 2000))"
    root = lambda a, b, c: (f"sqrt({a} + q)", f"{b} / sqrt({a} + q)", f"sqrt({c} + q - ({b}) * ({b}) / ({a} + q))")
    l11, l21, l22 = root("c11", "c12", "c22")
    r11, r21, r22 = root("v11", "v12", "v22")
    return (f"pa AS (SELECT mutation, year, d, m1 + {l11} * e1 AS w1, m2 + {l21} * e1 + {l22} * e2 AS w2 FROM (SELECT k.*, d, 1e-9 * greatest((c11 + c22) / 2, 1e-12) AS q, {noise(0, 'year')} AS e1, {noise(1, 'year')} AS e2 FROM {top} k, range({PATHS.draws}) r(d) WHERE year = (SELECT max(year) FROM e)) UNION ALL"
            f" SELECT mutation, year, d, m1 + j11 * (w1 - m1) + j12 * (w2 - m2) + {r11} * e1, m2 + j21 * (w1 - m1) + j22 * (w2 - m2) + {r21} * e1 + {r22} * e2"
            f" FROM (SELECT *, 1e-9 * greatest((v11 + v22) / 2, 1e-12) AS q, {noise(0, 'year')} AS e1, {noise(1, 'year')} AS e2"
            f" FROM (SELECT *, c11 - c11 * j11 - c12 * j12 AS v11, c12 - c11 * j21 - c12 * j22 AS v12, c22 - c12 * j21 - c22 * j22 AS v22"
            f" FROM (SELECT k.*, d, w1, w2, (c11 * (c22 + {tau}) - c12 * c12) / det AS j11, (c12 * (c11 + {tau}) - c11 * c12) / det AS j12, (c12 * (c22 + {tau}) - c22 * c12) / det AS j21, (c22 * (c11 + {tau}) - c12 * c12) / det AS j22"
            f" FROM (SELECT *, (c11 + {tau}) * (c22 + {tau}) - c12 * c12 AS det FROM {top}) k JOIN pa ON pa.mutation = k.mutation AND pa.year = k.year + 1))))")


@query(f"WITH RECURSIVE {OBS}, {_EM}, {_paths_sql()} SELECT mutation, CAST(year AS INTEGER) AS t, CAST(d + 1 AS INTEGER) AS draw, round(w1, 5) AS w1, round(w2, 5) AS w2 FROM pa")
def posterior_paths(spark, sf_dir):
    """Joint draws of the weights of all years, for one frequency, from the fit of all surveys."""
    rows = _placed(spark, sf_dir)
    s = dataclasses.replace(PATHS, **{k: getattr(_settings(rows), k) for k in ("first_year", "last_year")})
    hyper = rows.select("mutation", F.lit(EXACT_ELL).alias("ell_km"), F.lit(EXACT_TAU2).alias("tau2_year")).distinct()
    fits = model.fit_models(rows, hyper, s, _noise)
    draws = fits.select("mutation", "t", F.explode(F.sequence(F.lit(1), F.lit(s.draws))).alias("draw"), "weights")
    return draws.select("mutation", "t", "draw", *[F.round(F.element_at("weights", F.col("draw") + k * s.draws), 5).alias(f"w{k + 1}") for k in range(2)])


def _online_sql() -> str:
    """One pass: weights of a year at the mean before it, then survey by survey."""
    wx, wy = map(float, rff.frequencies(1, EXACT_ELL, EXACT.seed)[0])
    z0, tau = kalman.Z0, EXACT_TAU2
    eta = f"({z0!r} + f1 * y1 + f2 * y2)"
    w = f"greatest(CASE WHEN abs({eta}) >= 1e-6 THEN 0.5 * n / abs({eta}) * (exp(abs({eta})) - 1) / (exp(abs({eta})) + 1) ELSE n / 4 END, 1e-10)"
    return (f"pl AS (SELECT mutation, year, {_X} AS x_km, {_Y} AS y_km, sum(numerator) AS y, sum(denominator) AS n FROM obs WHERE denominator > 0 GROUP BY mutation, year, longitude, latitude),"
            f" ys AS (SELECT DISTINCT mutation, year, year - coalesce(lag(year) OVER (PARTITION BY mutation ORDER BY year), (SELECT min(year) - 1 FROM pl)) AS gap FROM (SELECT DISTINCT mutation, year FROM pl)),"
            f" st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mutation ORDER BY year, kind, x_km, y_km) AS step FROM (SELECT mutation, year, 1 AS kind, 0 AS gap, x_km, y_km, y, n, cos({wx!r} * x_km + {wy!r} * y_km) AS f1, sin({wx!r} * x_km + {wy!r} * y_km) AS f2 FROM pl"
            f" UNION ALL SELECT mutation, year, 0, gap, NULL, NULL, NULL, NULL, NULL, NULL FROM ys)),"
            f" en AS (SELECT mutation, year, max(step) AS step FROM st GROUP BY ALL),"
            f" fl AS (SELECT DISTINCT mutation, CAST(0 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS m1, CAST(0 AS DOUBLE) AS m2, CAST(0 AS DOUBLE) AS c11, CAST(0 AS DOUBLE) AS c12, CAST(0 AS DOUBLE) AS c22, CAST(0 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS y2 FROM st UNION ALL"
            f" SELECT mutation, next, CASE kind WHEN 0 THEN m1 ELSE m1 + g1 * miss / s END, CASE kind WHEN 0 THEN m2 ELSE m2 + g2 * miss / s END,"
            f" CASE kind WHEN 0 THEN c11 + gap * {tau} ELSE c11 - g1 * g1 / s END, CASE kind WHEN 0 THEN c12 ELSE c12 - g1 * g2 / s END, CASE kind WHEN 0 THEN c22 + gap * {tau} ELSE c22 - g2 * g2 / s END,"
            f" CASE kind WHEN 0 THEN m1 ELSE y1 END, CASE kind WHEN 0 THEN m2 ELSE y2 END"
            f" FROM (SELECT *, f1 * (c11 * f1 + c12 * f2) + f2 * (c12 * f1 + c22 * f2) + 1 / w AS s, c11 * f1 + c12 * f2 AS g1, c12 * f1 + c22 * f2 AS g2, (y - n / 2) / w - {z0!r} - f1 * m1 - f2 * m2 AS miss"
            f" FROM (SELECT fl.*, u.step AS next, kind, gap, y, n, f1, f2, {w} AS w FROM fl JOIN st u ON u.mutation = fl.mutation AND u.step = fl.step + 1)))")


@query(f"WITH RECURSIVE {OBS}, {_online_sql()} SELECT mutation, CAST(year AS INTEGER) AS year, round(m1, 6) AS m1, round(m2, 6) AS m2, round(c11, 7) AS c11, round(c22, 7) AS c22 FROM fl JOIN en USING (mutation, step)")
def filter_stream(spark, sf_dir):
    """The filter as a stream: every year of the surveys a micro-batch, for one frequency."""
    rows = stored(_placed(spark, sf_dir).select("mutation", "year", "x_km", "y_km", "numerator", "denominator"), "surveys")
    path = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    years = sorted(r[0] for r in rows.select("year").distinct().collect())
    for y in years:  # files in the order of years
        rows.filter(F.col("year") == y).coalesce(1).write.mode("append").parquet(f"{path}/in")
    before = spark.conf.get(B.PROVIDER[0], None)
    spark.conf.set(*B.PROVIDER)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = B.filtered(stream, 1, EXACT_ELL, EXACT_TAU2, years[0] - 1 if years else 0)
        done = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{path}/out/batch={i}"))
        done.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(B.PROVIDER[0]) if before is None else spark.conf.set(B.PROVIDER[0], before)
    made = B.advanced(spark.read.schema(B.OUT + ", batch int").parquet(f"{path}/out"))
    return made.select("mutation", "year", *[F.round(F.col("m")[i], 6).alias(f"m{i + 1}") for i in range(2)], *[F.round(F.col("spread")[i], 7).alias(f"c{i + 1}{i + 1}") for i in range(2)])


def _cells_sql(s: model.Settings) -> str:
    """cell: the grid with kilometres and the features of the one frequency."""
    wx, wy = map(float, rff.frequencies(1, EXACT_ELL, s.seed)[0])
    x, y = _laea_sql("x", "y", 35.0, 5.0)
    dx, dy = (BOX.xmax - BOX.xmin) / (s.nx - 1), (BOX.ymax - BOX.ymin) / (s.ny - 1)
    return (f"cell AS MATERIALIZED (SELECT pixel, x, y, cos({wx!r} * {x} + {wy!r} * {y}) AS f1, sin({wx!r} * {x} + {wy!r} * {y}) AS f2"
            f" FROM (SELECT i + 1 AS pixel, {BOX.xmin!r} + (i % {s.nx}) * {dx!r} AS x, {BOX.ymin!r} + (i // {s.nx}) * {dy!r} AS y FROM range({s.nx * s.ny}) r(i)))")


@query(f"WITH RECURSIVE {OBS}, {_EM}, {_cells_sql(EXACT)}, v AS (SELECT mutation, CAST(year AS INTEGER) AS t, pixel, x, y, {kalman.Z0!r} + f1 * m1 + f2 * m2 AS mean_z, sqrt(greatest(f1 * f1 * c11 + 2 * f1 * f2 * c12 + f2 * f2 * c22, 0)) AS sd FROM b{EXACT.rounds}, cell)"
       " SELECT mutation, t, pixel, round(x, 6) AS x, round(y, 6) AS y, round(mean_z, 5) AS mean_z, round(1 / (1 + exp(-(mean_z - 1.96 * sd))), 6) AS low, round(1 / (1 + exp(-(mean_z + 1.96 * sd))), 6) AS high FROM v")
def pointwise_surface(spark, sf_dir):
    """Mean and 95 % band of every cell and year from the smoothed weights, for one frequency."""
    means, s = _smoothed(spark, sf_dir)
    out = model.pointwise(means, model.prediction_cells(spark, BOX, s, (35.0, 5.0)), s)
    return _rounded(_rounded(out, "x", "y", "low", "high"), "mean_z", digits=5)


#: Draws that a formula gives: two weights, nine draws.
DRAWS = 9
_DRAWN = (f"drawn AS (SELECT mutation, year AS t, d, 2 * sin(0.7 * d + 0.11 * (year - 2000)) AS w1, 2 * sin(1.3 + 0.7 * d + 0.11 * (year - 2000)) AS w2 FROM (SELECT DISTINCT mutation, year FROM obs), range({DRAWS}) r(d)),"
          f" v AS (SELECT mutation, t, d, pixel, x, y, 1 / (1 + exp(-({kalman.Z0!r} + f1 * w1 + f2 * w2))) AS p FROM drawn, cell)")


def _drawn(spark, sf_dir) -> tuple[DataFrame, model.Settings]:
    rows = surveys(spark, sf_dir).select("mutation", F.col("year").alias("t")).distinct()
    one = lambda k: 2 * F.sin(1.3 * F.floor(k / DRAWS) + 0.7 * (k % DRAWS) + 0.11 * (F.col("t") - 2000))
    return rows.select("mutation", "t", F.lit(EXACT_ELL).alias("ell_km"), F.transform(F.sequence(F.lit(0), F.lit(2 * DRAWS - 1)), one).alias("weights")), EXACT


@query(f"WITH {OBS}, {_cells_sql(EXACT)}, {_DRAWN} SELECT mutation, t, pixel, round(x, 6) AS x, round(y, 6) AS y, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_cont(p, 0.975) - quantile_cont(p, 0.025), 6) AS ci_width,"
       " round(avg(CAST(p > 0.01 AS INTEGER)), 6) AS ex_1, round(avg(CAST(p > 0.05 AS INTEGER)), 6) AS ex_5, round(avg(CAST(p > 0.1 AS INTEGER)), 6) AS ex_10 FROM v GROUP BY ALL")
def surface_of_draws(spark, sf_dir):
    """The surface's reduction of draws, on draws that SQL can make too."""
    fits, s = _drawn(spark, sf_dir)
    return _rounded(model.surface(fits, model.prediction_cells(spark, BOX, s, (35.0, 5.0)), s), "x", "y", "mean", "median", "ci_width", "ex_1", "ex_5", "ex_10")


@query(f"WITH {OBS}, {_RECT}, {_cells_sql(EXACT)}, {_DRAWN} SELECT mutation, id_1, t, CAST(d + 1 AS INTEGER) AS draw, round(avg(p), 6) AS mean_p FROM v JOIN rect ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY ALL")
def region_draws(spark, sf_dir):
    """Regional means of every draw, on draws that SQL can make too."""
    fits, s = _drawn(spark, sf_dir)
    return _rounded(model.region_draws(fits, _cells(spark, s), s), "mean_p")


_HELD = "held AS (SELECT x, y, id_1 FROM (SELECT DISTINCT x, y FROM l) CROSS JOIN edge GROUP BY x, y, id_1 HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1)"


@query(f"WITH {OBS}, {_LONG}, {_EDGES}, {_HELD} SELECT x, y, t, mutation, CASE WHEN (x, y) IN (SELECT (x, y) FROM held) THEN round(p, 6) END AS p FROM l")
def mask_dissolved(spark, sf_dir):
    """The mask of a union of overlapping polygons: its rings are made first, then points are tested against them."""
    return _rounded(S.mask(_long(spark, sf_dir), S.dissolve(shapes(spark))), "p").select("x", "y", "t", "mutation", "p")


@query(f"WITH {OBS}, {_LONG}, {_EDGES}, {_HELD}, {_RECT} SELECT x, y, t, mutation, held.id_1, name_1 FROM l JOIN held USING (x, y) JOIN rect ON x BETWEEN rect.x1 AND rect.x2 AND y BETWEEN rect.y1 AND rect.y2")
def spatial_join_intersection(spark, sf_dir):
    """Points in the intersections of two polygon tables."""
    both = S.intersect(S.repaired(shapes(spark)), rectangles(spark).drop("id_1"), ["id_1"], ["name_1"])
    return S.spatial_join(_long(spark, sf_dir), both, ["id_1", "name_1"]).select("x", "y", "t", "mutation", "id_1", "name_1")


@query(f"WITH {OBS} SELECT survey_id, mutation, year, country_name, CAST(dense_rank() OVER (ORDER BY country_name) AS INTEGER) AS country_level, CASE mutation WHEN 'crt:76:T' THEN 1 WHEN 'k13:561:H' THEN 2 ELSE 0 END AS mutation_level FROM obs")
def factor_levels(spark, sf_dir):
    rows = surveys(spark, sf_dir).select("survey_id", "mutation", "year", "country_name")
    out = G.with_level(G.with_level(rows, "country_name", "country_level"), "mutation", "mutation_level", ["crt:76:T", "k13:561:H"])
    return out.withColumn("mutation_level", F.coalesce("mutation_level", F.lit(0)))


def _ticks_sql(axis: str, step: float) -> str:
    return f"SELECT '{axis}' AS axis, unnest(range(CAST(floor(min({axis}) / {step}) AS BIGINT), CAST(ceil(max({axis}) / {step}) AS BIGINT) + 1)) * {step} AS tick FROM l"


@query(f"WITH {OBS}, {_LONG} {_ticks_sql('x', 2.0)} UNION ALL {_ticks_sql('y', 3.0)}")
def map_ticks(spark, sf_dir):
    layers = R.map_layers(_long(spark, sf_dir), None, 2.0, 3.0)
    return spark.createDataFrame([(a, float(t)) for a in ("x", "y") for t in layers[f"{a}_ticks"]], "axis string, tick double")


@query(f"WITH {OBS} SELECT CAST(row_number() OVER (ORDER BY 100 * numerator / denominator, longitude, latitude, year, mutation) AS BIGINT) AS nth, longitude AS x, latitude AS y, year AS t, round(100 * numerator / denominator, 6) AS p, mutation FROM obs WHERE longitude BETWEEN {BOX.xmin} AND {BOX.xmax} AND latitude BETWEEN {BOX.ymin} AND {BOX.ymax}")
def map_points(spark, sf_dir):
    """Observed points of a map in the order in which they are drawn: the greatest on top, ties by place, year and marker."""
    points = O.observed_points(surveys(spark, sf_dir), BOX, 1900, 2100)
    drawn = R.map_layers(_long(spark, sf_dir), points, 2.0, 3.0)["points"]
    return _rounded(G.with_row_number(drawn, ["p", "x", "y", "t", "mutation"], "nth"), "p").select("nth", "x", "y", "t", "p", "mutation")


@query()
def variogram_fit(spark, sf_dir):
    return variogram.hyperparameters(_placed(spark, sf_dir), 600.0).drop("fitted_at")


@query()
def sim_field(spark, sf_dir):
    """Fields on the places and years of the surveys, one a marker."""
    rows = surveys(spark, sf_dir)
    axis = lambda c: sorted(r[0] for r in rows.select(c).distinct().collect())  # noqa: E731  axes of a grid
    return simulate.sim_field(spark, axis("longitude"), axis("latitude"), axis("year"), list(range(1, len(axis("mutation")) + 1)), length_space=8.0, length_time=2.0)


@query()
def sample_cells(spark, sf_dir):
    return simulate.draw_surveys(sim_field(spark, sf_dir).filter("seed = 1"), 100, 50)


#: Terms of a trend surface; folds go by the survey's number and year.
TERMS = ("1.0", "x", "y", "t", "x * y", "x * x", "y * y", "t * t")
_TREND = f"f AS (SELECT *, [{', '.join(TERMS)}] AS v, (CAST(survey_id AS BIGINT) * 7 + year) % 5 AS fold FROM (SELECT *, (longitude - 34.3) / 10.3 AS x, (latitude - 4.4) / 9.7 AS y, (year - 2017.6) / 4.1 AS t, {LOGIT} AS z FROM obs WHERE denominator > 0))"


def _trend(spark, sf_dir) -> dict[int, ridge.Sums]:
    rows = O.with_logit(O.valid_counts(surveys(spark, sf_dir)))
    x, y, t = (F.col("longitude") - 34.3) / 10.3, (F.col("latitude") - 4.4) / 9.7, (F.col("year") - 2017.6) / 4.1
    fold = (F.col("survey_id").cast("long") * 7 + F.col("year")) % 5
    terms = F.array(F.lit(1.0), x, y, t, x * y, x * x, y * y, t * t)
    return ridge.fold_sums(rows, terms, F.col("z"), fold, len(TERMS))


@query(f"WITH {OBS}, {_TREND} SELECT CAST(fold AS INTEGER) AS fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v[i] * v[j]), 5) AS xx, round(sum(v[i] * z), 5) AS xy, count(*) AS n FROM f, range(1, {len(TERMS) + 1}) a(i), range(1, {len(TERMS) + 1}) b(j) WHERE z IS NOT NULL GROUP BY ALL")
def ridge_sums(spark, sf_dir):
    """X'X and X'y of every fold of the trend surface, from one pass."""
    rows = [(f, i + 1, j + 1, float(s.xx[i, j]), float(s.xy[i]), s.n) for f, s in _trend(spark, sf_dir).items() for i in range(len(TERMS)) for j in range(len(TERMS))]
    return _rounded(spark.createDataFrame(rows, "fold int, i int, j int, xx double, xy double, n long"), "xx", "xy", digits=5)


@query()
def ridge_trend(spark, sf_dir):
    """Cross-validated error of 100 penalties, which one is best, and the weights of all."""
    folds = _trend(spark, sf_dir)
    errors, best, _ = ridge.cross_validated(folds)
    weights = ridge.path(sum(folds.values(), ridge.Sums(0.0, 0.0, 0.0, 0)))
    rows = [(float(p), float(e), bool(p == best), [float(x) for x in w]) for p, e, w in zip(ridge.PENALTIES, errors, weights.T)]
    return spark.createDataFrame(rows, "penalty double, error double, best boolean, weights array<double>")
