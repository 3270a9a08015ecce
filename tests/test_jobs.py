"""The chain of jobs over files: variogram, model, tables."""

import pytest

from geoprev import jobs
from geoprev.plans import catalogue
from geoprev.schema import POLYGONS


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    rows = catalogue.surveys(spark, sf_dir)
    rows.coalesce(1).write.csv(str(folder / "obs"), header=True)
    ring = lambda a, b, c, d: [[{"x": x, "y": y} for x, y in ((a, c), (b, c), (b, d), (a, d))]]
    boxes = [("K", "w", "K", "west", ring(26.0, 36.0, -6.0, 18.0)), ("K", "e", "K", "east", ring(36.0, 46.0, -6.0, 18.0))]
    spark.createDataFrame(boxes, POLYGONS).write.parquet(str(folder / "polygons"))
    return folder


def test_chain(spark, files):
    obs, out = str(files / "obs"), str(files / "out")
    own = ["--mutation", "crt:76:T", "--mutation", "mdr1:86:Y"]
    jobs.main(["variogram", obs, out, *own, "--pooled", "partner=crt:76:T,mdr1:86:Y"], spark)
    hyper = {r.mutation: r for r in spark.read.parquet(f"{out}/hyperparameters").collect()}
    assert set(hyper) == {"crt:76:T", "mdr1:86:Y", "partner"} and all(r.ell_km > 0 and r.fitted_at for r in hyper.values())
    assert spark.read.parquet(f"{out}/variogram_curve").count() == 1500 and spark.read.parquet(f"{out}/variogram_bins").select("mutation").distinct().count() == 3
    small = ["--features", "6", "--rounds", "2", "--draws", "20", "--nx", "6", "--ny", "5"]
    jobs.main(["model", obs, out, *own, "--as", "crt:76:T=partner", "--polygons", str(files / "polygons"), *small], spark)
    years = spark.read.parquet(f"{out}/surface").groupBy("mutation", "t").count().collect()
    assert {r["count"] for r in years} == {30} and {r.mutation for r in years} == {"crt:76:T", "mdr1:86:Y"}
    fits = {r.mutation: r.ell_km for r in spark.read.parquet(f"{out}/fits").select("mutation", "ell_km").distinct().collect()}
    assert fits == {"crt:76:T": hyper["partner"].ell_km, "mdr1:86:Y": hyper["mdr1:86:Y"].ell_km}
    regions = spark.read.parquet(f"{out}/regions").collect()
    assert {r.id_1 for r in regions} == {"w", "e"} and all(r.lower <= r.mean_prevalence <= r.upper for r in regions)
    jobs.main(["tables", out, *own, "--cell-area", "2.5"], spark)
    area = spark.read.csv(f"{out}/tables/area_over_time.csv", header=True, inferSchema=True).collect()
    assert len(area) == len(years) and all(r.area_ex_1 == 2.5 * r.n_ex_1 for r in area)
    assert spark.read.csv(f"{out}/tables/latest_by_region.csv", header=True).count() == 4
    assert spark.read.csv(f"{out}/tables/peak_regions.csv", header=True).count() == len(years)


def test_arguments():
    for wrong in ([], ["fly"], ["model", "obs"], ["tables"]):
        with pytest.raises(SystemExit):
            jobs.main(wrong)
