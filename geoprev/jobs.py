"""Jobs over files, one after the other: hyper-parameters, model, report tables.

    python -m geoprev.jobs variogram OBSERVATIONS.csv OUT [--mutation M ...] [--pooled NAME=M1,M2]
    python -m geoprev.jobs model OBSERVATIONS.csv OUT [--mutation M ...] [--as M=NAME] [--polygons P] [--box X1 X2 Y1 Y2] [--features D] ...
    python -m geoprev.jobs tables OUT [--mutation M ...] [--cell-area KM2]

All mutations of a job go through one plan; without --mutation these are the ones with positives. OUT holds:

    hyperparameters/      a row for each mutation or pooled name
    variogram_bins/       mutation, bin, dist, gamma, np    (plot data)
    variogram_curve/      mutation, dist, gamma             (plot data)
    surface/              by mutation: t, pixel, x, y, mean, median, ci_width, ex_*
    regions/              by mutation: id_1, t, lower, mean_prevalence, upper (with polygons)
    tables/*.csv          area over time, peak region and latest values by region
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions.geo import EAST_AFRICA, Box
from .operators import obs as O
from .operators import pairs as P
from .operators import report as R
from .operators import spatial as S
from .parameters import AREA_MUTATIONS, HIGH_RISK
from .plans import model, variogram
from .sources import store

CENTRE = (35.0, 5.0)


def observations(spark: SparkSession, path: str, mutations: list[str] | None = None) -> DataFrame:
    """Surveys with counts, the combined marker, a logit, kilometres and a number; only mutations that have positives."""
    rows = O.with_logit(O.valid_counts(O.add_combined(store.read_observations(spark, path), ordered=False)))
    if mutations:
        rows = rows.filter(F.col("mutation").isin(mutations))
    rows, _ = model.local_km(O.with_positives(rows, "numerator"), CENTRE)
    return rows.withColumn("id", F.xxhash64("study_id", "survey_id", "year", "longitude", "latitude", "mutation")).withColumn("day", X.midyear(F.col("year")))


def run_variogram(spark: SparkSession, obs_path: str, out: str, mutations: list[str] | None = None, pooled: dict[str, list[str]] | None = None, radius_km: float = 75.0, width_km: float = 25.0) -> None:
    """Fit each mutation, and each pooled name over all its mutations together; write the records and the plot data."""
    wanted = None if mutations is None else [*mutations, *(m for ms in (pooled or {}).values() for m in ms)]
    rows = observations(spark, obs_path, wanted)
    for name, members in (pooled or {}).items():
        rows = rows.unionByName(rows.filter(F.col("mutation").isin(members)).withColumn("mutation", F.lit(name)))
    fits = variogram.hyperparameters(rows, radius_km, width_km)
    fits.coalesce(1).write.mode("overwrite").parquet(f"{out}/hyperparameters")
    P.variogram_bins(rows, width_km).write.mode("overwrite").parquet(f"{out}/variogram_bins")
    curve = spark.range(500).crossJoin(F.broadcast(fits.select("mutation", "psill", "range_km"))).withColumn("dist", F.col("id") * (1500.0 / 499))  # a row a mutation
    curve.select("mutation", "dist", X.gauss_variogram(F.col("dist"), F.col("psill"), F.col("range_km"), variogram.NUGGET).alias("gamma")).write.mode("overwrite").parquet(f"{out}/variogram_curve")


def run_model(spark: SparkSession, obs_path: str, out: str, mutations: list[str] | None = None, stand_in: dict[str, str] | None = None, polygons: str | None = None, box: Box = EAST_AFRICA, settings: model.Settings | None = None) -> None:
    """Fit and map all mutations; stand_in: mutation -> name of the hyper-parameters it takes instead of its own."""
    rows = observations(spark, obs_path, mutations)
    hyper = spark.read.parquet(f"{out}/hyperparameters").select(F.col("mutation").alias("name"), "ell_km", "tau2_year")
    names = R.named(F.col("mutation"), stand_in) if stand_in else F.lit(None).cast("string")
    own = rows.select("mutation").distinct().withColumn("name", F.coalesce(names, F.col("mutation"))).join(hyper, "name").drop("name")
    if settings is None:
        r = rows.agg(F.min("year"), F.max("year")).first()
        settings = model.Settings(first_year=r[0], last_year=r[1])
    store.save_model({"fits": model.fit_models(rows, own, settings)}, out)
    fits = spark.read.parquet(f"{out}/fits").select("mutation", "t", "ell_km", "weights")
    cells = model.prediction_cells(spark, box, settings, CENTRE)
    store.save_model({"surface": model.surface(fits, cells, settings)}, out)
    if polygons:
        shapes = S.repaired(store.read_polygons(spark, polygons))
        held = S.spatial_join(cells.drop("id_1"), shapes, ["id_1"], how="left")
        store.save_model({"regions": R.region_interval(model.region_draws(fits, held, settings), ["mutation", "id_1", "t"])}, out)


def run_tables(spark: SparkSession, out: str, mutations: list[str] | None = None, cell_area: float = 1.0) -> list[str]:
    """Report tables as CSV; the paths written."""
    surface = spark.read.parquet(f"{out}/surface").filter(F.col("mutation").isin(mutations or AREA_MUTATIONS))
    columns = [c for c in surface.columns if c.startswith("ex_")]
    paths = [store.save_csv(R.area_over_time(surface, cell_area, ["mutation", "t"], columns, HIGH_RISK).orderBy("mutation", "t"), "area_over_time", f"{out}/tables")]
    jvm = spark.sparkContext._jvm
    regions = jvm.org.apache.hadoop.fs.Path(f"{out}/regions")
    if regions.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(regions):
        rows = spark.read.parquet(f"{out}/regions")
        rows = rows.filter(F.col("mutation").isin(mutations)) if mutations else rows
        paths.append(store.save_csv(R.peak(rows, ["mutation", "t"], "mean_prevalence", ["id_1"]).orderBy("mutation", "t"), "peak_regions", f"{out}/tables"))
        paths.append(store.save_csv(R.last_point(rows, ["mutation", "id_1"]).orderBy("mutation", "id_1"), "latest_by_region", f"{out}/tables"))
    return paths


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    pairs = lambda text: tuple(text.split("=", 1))
    parser = argparse.ArgumentParser(prog="geoprev.jobs", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("variogram", "model", "tables"):
        job = jobs.add_parser(name)
        if name != "tables":
            job.add_argument("observations")
        job.add_argument("out")
        job.add_argument("--mutation", action="append", dest="mutations")
    jobs.choices["variogram"].add_argument("--pooled", action="append", type=pairs, default=[], metavar="NAME=M1,M2")
    fit = jobs.choices["model"]
    fit.add_argument("--as", action="append", type=pairs, default=[], dest="stand_in", metavar="M=NAME")
    fit.add_argument("--polygons")
    fit.add_argument("--box", nargs=4, type=float, metavar=("X1", "X2", "Y1", "Y2"))
    for f in dataclasses.fields(model.Settings):
        if f.type in ("int", int):
            fit.add_argument(f"--{f.name.replace('_', '-')}", type=int)
    jobs.choices["tables"].add_argument("--cell-area", type=float, default=1.0)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"geoprev-{a.job}").getOrCreate()
    if a.job == "variogram":
        run_variogram(spark, a.observations, a.out, a.mutations, {k: v.split(",") for k, v in a.pooled})
    elif a.job == "model":
        given = {f.name: getattr(a, f.name) for f in dataclasses.fields(model.Settings) if getattr(a, f.name, None) is not None}
        settings = None
        if given:
            years = {"first_year", "last_year"} - set(given)
            if years:
                r = observations(spark, a.observations, a.mutations).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")).first()
                given |= {y: r[y] for y in years}
            settings = model.Settings(**given)
        run_model(spark, a.observations, a.out, a.mutations, dict(a.stand_in), a.polygons, Box(*a.box) if a.box else EAST_AFRICA, settings)
    else:
        for path in run_tables(spark, a.out, a.mutations, a.cell_area):
            print(path)


if __name__ == "__main__":
    main()
