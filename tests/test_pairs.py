"""Pairs by cells, sums over places and blocks, against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoprev.operators import pairs as P
from geoprev.operators.quantiles import exact_quantile
from geoprev.plans import ridge


@pytest.fixture(scope="module")
def rows():
    """mutation, id, year, x_km, y_km, z: crowded places, far ones, points on cell borders, missing z."""
    r = np.random.default_rng(3)
    out = []
    for i in range(400):
        x, y = (0.0, 0.0) if i % 5 == 0 else (75.0 * r.integers(-3, 4), 75.0 * r.integers(-3, 4)) if i % 5 == 1 else r.normal(size=2) * 150
        out.append((f"m{i % 3 % 2}", i, int(2015 + i % 4), float(x), float(y), None if i % 17 == 0 else float(r.normal() - 3)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "mutation string, id long, year int, x_km double, y_km double, z double").withColumn("day", F.make_date("year", F.lit(7), F.lit(1)))


def all_pairs(rows, apart, same=True):
    return [(a, b, math.hypot(a[3] - b[3], a[4] - b[4])) for a in rows for b in rows if b[2] == a[2] + apart and (not same or a[0] == b[0])]


def test_one_year_pairs(df, rows):
    got = sorted((r.id1, r.id2, round(r.dist, 6), r.dz and round(r.dz, 6)) for r in P.one_year_pairs(df, 75.0).collect())
    want = sorted((a[1], b[1], round(d, 6), None if None in (a[5], b[5]) else round(b[5] - a[5], 6)) for a, b, d in all_pairs(rows, 1) if d <= 75.0)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 500
    assert all((g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 2e-6) for g, w in zip(got, want))
    plan = P.one_year_pairs(df, 75.0)._jdf.queryExecution().executedPlan().toString()
    assert "a_cx" in plan.split("Join")[1].split("\n")[0] and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("same", [True, False])
def test_tau2(df, rows, same):
    got = {r["mutation"] if same else "": r for r in P.tau2_near(df, 75.0, ("mutation",) if same else ()).collect()}
    want: dict = {}
    for a, b, d in all_pairs(rows, 1, same):
        if d <= 75.0 and None not in (a[5], b[5]):
            want.setdefault(a[0] if same else "", []).append((b[5] - a[5]) ** 2)
    assert {k: r.n_pairs for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k].tau2_year == pytest.approx(np.mean(v), rel=1e-9) for k, v in want.items())


@pytest.mark.parametrize("cutoff", [None, 60.0, 200.0])
def test_variogram_bins(df, rows, cutoff):
    want: dict = {}
    for a, b, d in all_pairs(rows, 1):
        leap = a[2] == 2015  # 365 days from 1 July 2015 end a day before 1 July 2016
        if None not in (a[5], b[5]) and not leap and (cutoff is None or d <= cutoff):
            want.setdefault((a[0], int(d // 25)), []).append((d, (a[5] - b[5]) ** 2))
    got = {(r.mutation, r.bin): r for r in P.variogram_bins(df, cutoff_km=cutoff).collect()}
    assert {k: r.np for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        assert got[k].dist == pytest.approx(np.mean([d for d, _ in v]), abs=1e-9) and got[k].gamma == pytest.approx(np.mean([s for _, s in v]) / 2, rel=1e-9)


@pytest.mark.parametrize("by,block", [(["mutation"], 2048), (["mutation"], 37), (None, 50)])
def test_loglike_of_blocks(spark, df, by, block):
    d = df.select("mutation", "id", F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.col("year").alias("t"), "z")
    want = {r["mutation"] if by else "": r for r in P.vario_loglike(P.pair_distances(d, by), 300.0, 2.0, 0.1, 0.9, by).collect()}
    got = {r["mutation"] if by else "": r for r in P.loglike_of_blocks(d, 300.0, 2.0, 0.1, 0.9, by, block=block).collect()}
    assert got.keys() == want.keys() and all(got[k].n_pairs == want[k].n_pairs and got[k].loglike == pytest.approx(want[k].loglike, rel=1e-10) for k in want)
    assert P.loglike_of_blocks(d.limit(0), 300.0, 2.0, 0.1, 0.9, by).count() == 0


def test_exact_quantiles(spark):
    r = np.random.default_rng(1)
    for values in (r.normal(size=1001), r.integers(0, 3, 500).astype(float), np.r_[np.full(900, 7.0), r.normal(size=99) * 1e9], np.array([1.0, np.nextafter(1.0, 2.0)] * 40), np.array([5.0]), r.lognormal(0, 20, 300)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
        for q in (0.5, 1.0 if len(values) < 50 else 0.31):
            assert exact_quantile(df, "v", q, buckets=16, enough=5) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_ridge_from_sums_equals_refits(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 5))
    y = x @ [1, -2, 0, 0.5, 0] + 0.3 * r.normal(size=120)
    df = spark.createDataFrame([(a.tolist(), float(b), i % 6) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1.0, 0), ([1.0] * 5, None, 1), ([float("nan")] * 5, 1.0, 2)], "x array<double>, y double, fold int").repartition(5)
    folds = ridge.fold_sums(df, F.col("x"), F.col("y"), F.col("fold"), 5)
    assert {f: s.n for f, s in folds.items()} == dict.fromkeys(range(6), 20)
    errors, best, weights = ridge.cross_validated(folds)
    of = np.arange(120) % 6
    fit = lambda a, b, p: np.linalg.solve(a.T @ a + p * np.eye(5), a.T @ b)
    want = [np.mean(np.concatenate([(y[of == k] - x[of == k] @ fit(x[of != k], y[of != k], p)) ** 2 for k in range(6)])) for p in ridge.PENALTIES]
    assert np.allclose(errors, want, rtol=1e-9) and best == ridge.PENALTIES[int(np.argmin(want))]
    assert np.allclose(weights, fit(x, y, best), rtol=1e-9)
