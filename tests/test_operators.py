import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoprev.operators import grid as G
from geoprev.operators import obs as O
from geoprev.operators import pairs as P
from geoprev.operators import report as R
from geoprev.operators import spatial as S

OBS = "study_id string, survey_id string, year int, longitude double, latitude double, country_name string, numerator double, denominator double, mutation string"


@pytest.fixture()
def obs(spark):
    site = ("s", "v", 2015, 30.0, 1.0, "A")
    return spark.createDataFrame([(*site, 2.0, 10.0, "k13:A"), (*site, 3.0, 12.0, "K13:B"), (*site, 1.0, 5.0, "crt"), (*site[:2], 2016, *site[3:], None, 0.0, None)], OBS)


def test_combined(obs):
    out = O.add_combined(obs).collect()
    new = [r for r in out if r.mutation == "k13:comb"]
    assert len(out) == 5 and len(new) == 1
    assert (new[0].numerator, new[0].denominator) == (5, 12) and new[0].prevalence == pytest.approx(41.6667, abs=1e-4)
    assert out[-1].mutation is None  # missing markers sort last


def test_valid_counts(obs, spark):
    assert O.valid_counts(obs).count() == 3
    bad = spark.createDataFrame([(float("nan"), 1.0), (1.0, float("inf")), (1.0, -1.0), (0.0, 1.0)], "numerator double, denominator double")
    assert O.valid_counts(bad).count() == 1


def test_logit_guard(spark):
    rows = spark.createDataFrame([(13.0, 12.0), (12.0, 12.0)], "numerator double, denominator double")
    assert [r.z for r in O.with_logit(rows).orderBy("numerator").collect()] == [pytest.approx(math.log(12.5 / 0.5)), None]


def test_crop_keeps_the_border(spark):
    pts = spark.createDataFrame([(28.0, -4.0), (37.0, 5.0), (37.1, 0.0), (None, 1.0)], "x double, y double")
    assert O.crop(pts, (28, 37), (-4, 5)).count() == 2


def test_not_in_keeps_missing(spark):
    d = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert {r.c for r in O.not_in(d, "c", ["a"]).collect()} == {None, "b"}


def test_blocks_keep_years_outside(spark):
    d = spark.createDataFrame([(0.0, 0.0, 2012, 0.2), (0.0, 0.0, 2013, None), (0.0, 0.0, 2013, 0.4), (0.0, 0.0, 2030, 0.9)], "x double, y double, t int, p double")
    assert {r.t: round(r.p, 9) for r in R.avg_blocks(d).collect()} == {"2012-2013": 0.3, None: 0.9}


def test_raster_order(spark):
    flat = spark.createDataFrame([(2012, [1.0, 2.0, 3.0, 4.0]), (2013, [5.0, 6.0, 7.0, 8.0])], "t int, values array<double>")
    got = {(r.x, r.y, r.t): r.p for r in G.raster_long(flat, [10, 20], [1, 2]).collect()}
    assert got == {(10, 1, 2012): 1, (20, 1, 2012): 2, (10, 2, 2012): 3, (20, 2, 2012): 4, (10, 1, 2013): 5, (20, 1, 2013): 6, (10, 2, 2013): 7, (20, 2, 2013): 8}


def test_row_numbers(spark):
    d = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    out = G.with_row_number(d, ["k"]).collect()
    assert all(r.id == r.k + 1 for r in out) and len(out) == 1000


def test_distances(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 1, 1.0), (2, 3.0, 4.0, 2, 3.0), (3, 0.0, 1.0, 4, -1.0)], "id long, x double, y double, t int, z double")
    got = sorted(tuple(r) for r in P.pair_distances(d).collect())
    assert got == [(2, 1, 5.0, 1, 2.0), (3, 1, 1.0, 3, -2.0), (3, 2, pytest.approx(4.2426406871), 2, -4.0)]
    ll = P.vario_loglike(P.pair_distances(d), 5, 2, 0.1, 0.9).first()
    assert ll.loglike == pytest.approx(-16.67515866940264) and ll.n_pairs == 3


def test_pair_count(spark):
    d = spark.range(40).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(1).alias("t"), F.rand(3).alias("z"))
    assert P.pair_distances(d).count() == 40 * 39 // 2


def test_one_year_pairs_are_a_hash_join(spark):
    d = spark.range(10).select("id", F.lit("m").alias("mutation"), (F.col("id") % 3).cast("int").alias("year"), F.col("id").cast("double").alias("x_km"), F.lit(0.0).alias("y_km"), F.lit(1.0).alias("z"))
    plan = P.one_year_pairs(d)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_leap_years_leave_the_lag(spark):
    days = spark.sql("SELECT 'm' AS mutation, id, make_date(CAST(id AS INT), 7, 1) AS day, 0D AS x_km, 0D AS y_km, CAST(id AS DOUBLE) AS z FROM VALUES (2015), (2016), (2018), (2019) AS v(id)")
    assert P.variogram_bins(days).first()["np"] == 1


def test_quantiles_and_exceedance(spark):
    d = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 10.0)], "k int, p double")
    r = R.posterior_summary(d, ["k"]).first()
    assert (r["mean"], r["median"], r["ci_width"]) == pytest.approx((4, 2.5, 9.475 - 1.075))
    e = R.exceedance(spark.createDataFrame([(1, v) for v in (0.005, 0.01, 0.02, 0.2)], "k int, p double"), ["k"]).first()
    assert (e.ex_1, e.ex_5, e.ex_10) == (0.5, 0.25, 0.25)


def test_lookup_checks(spark):
    df, look = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(PySparkException, match="k repeats in the lookup: a"):
        R.lookup_join(df.filter("k = 'a'"), look, "k", ["v"]).collect()
    with pytest.raises(PySparkException, match="k is not in the lookup: b"):
        R.lookup_join(df, look.filter("v = 1"), "k", ["v"]).count()
    with pytest.raises(PySparkException, match="NULL"):
        R.lookup_join(spark.createDataFrame([(None,)], "k string"), look.filter("v = 1"), "k", ["v"]).collect()
    assert sorted(map(tuple, R.lookup_join(df.filter("k = 'a'"), look.filter("v = 2").union(look.filter("v = 2")), "k", ["v"]).collect())) == [("a", 2)]
    assert R.lookup_join(df, look, "k", ["v"], strict=False).count() == 3


def test_checks_cost_no_job(spark):
    """A strict lookup and two counted tables are one job."""
    df, look = spark.range(5).select(F.col("id").cast("string").alias("k")), spark.range(9).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    before, seen = R.counted(df, "before")
    after, also = R.counted(R.lookup_join(before, look, "k", ["v"]), "after")
    spark.sparkContext.setJobGroup("lookup", "lookup")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else every stage is a job
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(after.collect()) == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")) == 1
    R.checked_equal_rows(seen, also, "lookup")
    some, few = R.counted(df.filter("k < '2'"), "few")
    assert some.collect() and few.get["rows"] == 2
    with pytest.raises(ValueError, match="5 rows became 2"):
        R.checked_equal_rows(seen, few, "lookup")


def test_sampling(spark):
    d = spark.range(50)
    a, b = (R.sample_rows(d, 10, 3, ["id"]).collect() for _ in range(2))
    assert a == b and len({r.id for r in a}) == 10
    with pytest.raises(ValueError):
        R.sample_rows(d, 51, 3, ["id"])


POLYGONS = "id_1 string, rings array<array<struct<x: double, y: double>>>"


def test_points_on_a_shared_border_match_both(spark):
    ring = lambda a, b: [[(a, 0.0), (b, 0.0), (b, 4.0), (a, 4.0)]]
    polys = spark.createDataFrame([("w", ring(0.0, 4.0)), ("e", ring(4.0, 8.0))], POLYGONS)
    pts = spark.createDataFrame([(4.0, 2.0, 0.5), (1.0, 1.0, 0.4), (9.0, 9.0, 0.3)], "x double, y double, p double")
    got = sorted((r.x, r.id_1 or "") for r in S.spatial_join(pts, polys, ["id_1"], how="left").collect())
    assert got == [(1, "w"), (4, "e"), (4, "w"), (9, "")]
    masked = {r.x: r.p for r in S.mask(pts, polys).collect()}
    assert masked == {4: 0.5, 1: 0.4, 9: None}


def test_clip_polygons(spark):
    from geoprev.functions.geo import Box

    polys = spark.createDataFrame([("a", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), ("b", [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]])], POLYGONS)
    out = S.clip(polys, Box(1, 3, 1, 3)).collect()
    assert [r.id_1 for r in out] == ["a"] and {(p.x, p.y) for p in out[0].rings[0]} == {(1, 1), (3, 1), (3, 3), (1, 3)}


def test_map_layers(spark):
    raster = spark.createDataFrame([(27.0, 1.0, 0.5)], "x double, y double, p double")
    layers = R.map_layers(raster, raster, 5, 5)
    assert layers["raster"].first().fill == 50 and layers["x_ticks"] == [25, 30] and layers["points"].count() == 1


def test_map_window(spark):
    square = [[(30.0, 0.0), (31.0, 0.0), (31.0, 1.0), (30.0, 1.0)]]
    land = spark.createDataFrame([("a", square)], POLYGONS)
    lake = spark.createDataFrame([("l", [[(0.0, 0.0), (60.0, 0.0), (60.0, 1.0), (0.0, 1.0)]])], POLYGONS)
    w = S.map_window(land, lake, 200)
    box = w["box"]
    assert box.xmin == pytest.approx(30 - 200 / 111.3195, abs=1e-3) and box.ymax == pytest.approx(1 + 200 / 111.3, abs=2e-2)
    assert min(p.x for p in w["water"].first().rings[0]) == pytest.approx(box.xmin) and w["land"].count() == 1
    with pytest.raises(ValueError):
        S.map_window(land.limit(0))


def test_fixed_values():
    from geoprev import parameters
    from geoprev.functions.geo import EAST_AFRICA

    assert len(parameters.ALL_MUTATIONS) == 24 and set(parameters.AREA_MUTATIONS) <= set(parameters.ALL_MUTATIONS)
    assert len(parameters.PREVALENCE_COLOURS) == 10 and EAST_AFRICA.padded(2).xmin == 25


@pytest.mark.parametrize("rectangles", [True, False])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_left_spatial_join_of_shuffled_points(spark, rectangles, adaptive):
    """Points behind a shuffle, with small partitions that adaptive execution merges as it likes: every point has its own regions."""
    own = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(6000).select("id", ((F.col("id") * 7919) % 2000 / 100).alias("x"), ((F.col("id") * 104729) % 1500 / 100).alias("y")).repartition("id")
        box = lambda a, b, c, d: [[{"x": x, "y": y} for x, y in ((a, c), (b, c), (b, d), (a, d))]]
        boxes = {"p": (1, 8, 1, 6), "q": (6, 12, 4, 11), "r": (30, 31, 0, 1)}
        polygons = spark.createDataFrame([(n, box(*map(float, b))) for n, b in boxes.items()], "name string, rings array<array<struct<x: double, y: double>>>")
        got = sorted(((r.id, r.name) for r in S.spatial_join(points, polygons, ["name"], how="left", rectangles=rectangles).cache().collect()), key=str)
        want = []
        for r in points.collect():
            held = [n for n, (a, b, c, d) in boxes.items() if a <= r.x <= b and c <= r.y <= d]
            want += [(r.id, n) for n in held or [None]]
        assert got == sorted(want, key=str)
    finally:
        spark.catalog.clearCache()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_left_spatial_join_keeps_points_without_a_place(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, 2.0, 2.0)], "id long, x double, y double")
    square = spark.createDataFrame([("s", [[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 3.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]])], "name string, rings array<array<struct<x: double, y: double>>>")
    assert sorted((r.id, r.name) for r in S.spatial_join(points, square, ["name"], how="left").collect()) == [(1, None), (2, None), (3, "s")]
    with pytest.raises(ValueError):
        S.spatial_join(points, square, ["name"], how="outer")
