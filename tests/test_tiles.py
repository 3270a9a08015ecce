"""The index of edges by tile against the test of whole rings."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoprev.functions.geo import inside
from geoprev.operators import spatial, tiles

RINGS = "name string, rings array<array<struct<x: double, y: double>>>"


def frame(spark, shapes):
    return spark.createDataFrame([(n, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for n, rings in shapes.items()], RINGS)


def star(k, radius, seed, cx=0.0, cy=0.0):
    r = np.random.default_rng(seed)
    turn = np.sort(r.random(k)) * 2 * math.pi
    far = radius * (0.4 + 0.6 * r.random(k))
    return [(float(cx + d * math.cos(t)), float(cy + d * math.sin(t))) for t, d in zip(turn, far)]


SHAPES = {
    "star": [star(60, 10, 1)], "ring": [star(40, 12, 2, 3, 3), star(12, 3, 3, 3, 3)], "box": [[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)]],
    "crossed": [[(-10, -10), (10, 10), (10, -10), (-10, 10)]], "steps": [[(0, 0), (4, 0), (4, 2), (8, 2), (8, 6), (0, 6)]], "line": [[(0, 0), (3, 3)]], "none": [],
    "triangle": [[(-7, 0), (0, 7), (7, 0)]], "far": [star(9, 2, 5, 100, -100)], "copy": [[(0, 0), (4, 0), (4, 2), (8, 2), (8, 6), (0, 6)]],
}


@pytest.mark.parametrize("size", [None, 1.0, 2.5, 40.0])
def test_equals_whole_rings(spark, size):
    """Points inside, outside, on corners, edges and tile sides, for several sizes of tiles."""
    r = np.random.default_rng(4)
    xy = np.unique(np.concatenate([r.normal(size=(400, 2)) * 8, r.integers(-12, 13, (200, 2)), r.integers(-24, 25, (200, 2)) / 2, [[100, -100], [1e6, 1e6]], [p for ring in SHAPES["star"] for p in ring][:20]]), axis=0)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in xy] + [(None, 1.0), (1.0, None), (float("nan"), 0.0), (float("inf"), 0.0)], "x double, y double")
    got = {(x.x, x.y, x.name) for x in spatial.spatial_join(points, frame(spark, SHAPES), ["name"], size=size).collect()}
    want = {(float(a), float(b), n) for n, rings in SHAPES.items() for (a, b), ok in zip(xy, inside(xy[:, 0], xy[:, 1], rings)) if ok}
    assert got == want
    left = spatial.spatial_join(points, frame(spark, SHAPES), ["name"], how="left", size=size)
    assert left.filter("name IS NULL").count() == points.count() - len({g[:2] for g in got})


def test_crowded_tile_is_dealt(spark):
    points = spark.range(500).select((F.col("id") / 100.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    shapes = spark.createDataFrame([(0, frame(spark, SHAPES).filter("name = 'box'").first()["rings"])], "pid long, rings array<array<struct<x: double, y: double>>>")
    places = points.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    one, many = (sorted(map(tuple, tiles.located(places, shapes, 50.0, crowd).collect())) for crowd in (1 << 16, 20))
    assert one == many and len(one) == points.filter("x <= 5 AND y <= 5").count()


def test_large_polygon_costs_little_more(spark):
    """4,000 points: 20,000 corners take at most three times as long as 100."""
    points = spark.createDataFrame(
        np.random.default_rng(7).uniform(-12, 12, (4000, 2)).tolist(), "x double, y double")
    took = {}
    for k in (100, 20_000):
        ring = star(k, 11, k)
        shapes = frame(spark, {"p": [ring]})
        best = []
        for _ in range(2):
            began = time.perf_counter()
            n = spatial.spatial_join(points, shapes, ["name"]).count()
            best.append(time.perf_counter() - began)
        took[k] = min(best)
        xy = np.array([tuple(r) for r in points.collect()])
        assert n == inside(xy[:, 0], xy[:, 1], [ring]).sum()
    assert took[20_000] < 3 * took[100] + 0.5
