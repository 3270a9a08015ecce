"""The distributed fit against the plain one, and its memory."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoprev.plans import fitting, kalman, model, rff

HYPER = [("a", 90.0, 0.1), ("b", 60.0, 0.3), ("c", 80.0, 0.2), ("none", 1.0, 1.0)]
SETTINGS = model.Settings(features=4, rounds=4, first_year=2013, last_year=2018)


def surveys(seed=0):
    """a: 300 places a year, b: a few, c: many in one year and none in others; places repeat and some counts can't be used."""
    r = np.random.default_rng(seed)
    rows = []
    for m, sizes in (("a", [300] * 6), ("b", [3, 0, 8, 1, 2, 5]), ("c", [0, 40, 0, 3, 0, 9])):
        for i, n in enumerate(sizes):
            x, y = r.integers(0, 40, (2, n)) * 5.0
            d = r.integers(1, 30, n).astype(float)
            rows += [(m, 2013 + i, float(a), float(b), float(np.floor(e * f)), float(e)) for a, b, e, f in zip(x, y, d, r.random(n))]
    return rows + [("a", 2013, 1.0, 1.0, float("nan"), 5.0), ("a", 2013, 1.0, 1.0, 1.0, 0.0), ("b", 2012, 0.0, 0.0, 5.0, 5.0)]


def plain(rows, m, ell, tau2):
    """kalman.em with the features of all years at once."""
    d = pd.DataFrame([x for x in rows if x[0] == m and 2013 <= x[1] <= 2018 and x[4] == x[4] and x[5] > 0], columns=["m", "year", "x", "y", "k", "n"])
    d = d.groupby(["year", "x", "y"], as_index=False)[["k", "n"]].sum()
    omega = rff.frequencies(SETTINGS.features, ell, SETTINGS.seed)
    years = [kalman.Year(rff.features(g[["x", "y"]].to_numpy(float), omega), g["k"].to_numpy(float), g["n"].to_numpy(float)) for g in (d[d["year"] == y] for y in SETTINGS.years)]
    _, p, _ = kalman.em(years, tau2, SETTINGS.rounds)
    return (*kalman.rts_smoother(p, covariances=True), p.loglik)


@pytest.mark.parametrize("part,fan,state", [(fitting.PART, 16, fitting.STATE), (20, 2, 1)])
def test_equals_the_plain_fit(spark, monkeypatch, part, fan, state):
    """In one part and in many, added level by level; all mutations in one go and one after the other."""
    monkeypatch.setattr(fitting, "FAN", fan)
    rows = surveys()
    obs = spark.createDataFrame(rows, "mutation string, year int, x_km double, y_km double, numerator double, denominator double").repartition(5)
    hyper = spark.createDataFrame(HYPER, "mutation string, ell_km double, tau2_year double")

    def moments(m, ell, p):
        mean, cov = kalman.rts_smoother(p, covariances=True)
        return pd.DataFrame({"m": m, "t": np.array(SETTINGS.years, np.int32), "ell": ell, "loglik": p.loglik, "mean": list(mean), "cov": [c.ravel() for c in cov]})

    out = fitting.em(obs, hyper, 4, 1, SETTINGS.years, 4, moments, "m string, t int, ell double, loglik double, mean array<double>, cov array<double>", part, state).collect()
    assert sorted((r.m, r.t) for r in out) == [(m, t) for m in "abc" for t in SETTINGS.years]
    for m, ell, tau2 in HYPER[:3]:
        mean, cov, loglik = plain(rows, m, ell, tau2)
        for r in (r for r in out if r.m == m):
            i = r.t - 2013
            assert r.ell == ell and r.loglik == pytest.approx(loglik, rel=1e-6)
            assert np.allclose(r.mean, mean[i], atol=1e-6) and np.allclose(np.reshape(r.cov, (8, 8)), cov[i], atol=1e-6)


def test_no_places(spark):
    obs = spark.createDataFrame([], "mutation string, year int, x_km double, y_km double, numerator double, denominator double")
    hyper = spark.createDataFrame(HYPER, "mutation string, ell_km double, tau2_year double")
    assert model.fit_models(obs, hyper, SETTINGS).count() == 0 and model.smoothed(obs, hyper, SETTINGS).count() == 0


def test_memory_does_not_grow_with_places():
    """Sums of 300,000 places at 2D = 80: their features are 192 MB, a task holds those of a block."""
    omega = {"m": rff.frequencies(40, 100.0, 1)}
    state = {"m": np.zeros((1, 80))}

    def batches(n):
        r = np.random.default_rng(1)
        for k in range(n):
            d = {"mutation": ["m"] * 3000, "year": np.full(3000, 2013, np.int32), "part": np.full(3000, k // 50), "x_km": r.random(3000), "y_km": r.random(3000), "numerator": np.ones(3000), "denominator": np.full(3000, 9.0)}
            yield pa.RecordBatch.from_pydict(d)

    peak = {}
    for n in (10, 100):
        tracemalloc.start()
        got = list(fitting.sums_of_parts(batches(n), omega, state, 2013))
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(i.n for _, i in got) == 3000 * n
    assert peak[100] < 1.2 * peak[10] + 1e6 and peak[100] < 300_000 * 80 * 8 / 10


def test_means_are_those_of_the_smoother():
    r = np.random.default_rng(2)
    omega = rff.frequencies(3, 50.0, 1)
    years = [kalman.Year(rff.features(r.normal(size=(n, 2)) * 50, omega), np.floor(9 * r.random(n)), np.full(n, 9.0)) for n in (2, 0, 20, 6)]
    w, z = zip(*(kalman.pseudo(y.phi, y.y, y.n, np.zeros(6)) for y in years))
    p = kalman.kalman_filter(years, z, w, 0.2)
    assert np.allclose(kalman.smoothed_means(p), kalman.rts_smoother(p)[0], atol=1e-12)


def test_a_hot_mutation_in_parts(spark):
    """Forty parts of a mutation and year, added by a tree, say what one part says."""
    rows = spark.range(4000).select(F.lit("m").alias("mutation"), F.lit(2013).alias("year"), F.col("id").cast("double").alias("x_km"), F.lit(0.0).alias("y_km"), F.lit(1.0).alias("numerator"), F.lit(9.0).alias("denominator"))
    hyper = spark.createDataFrame([("m", 90.0, 0.1)], "mutation string, ell_km double, tau2_year double")
    finish = lambda m, ell, p: pd.DataFrame({"m": [m], "norm": [float(np.linalg.norm(p.m_filt))]})
    many, one = (fitting.em(rows, hyper, 2, 1, [2013], 2, finish, "m string, norm double", part=part).collect()[0].norm for part in (100, 5000))
    assert many == pytest.approx(one, rel=1e-9) and many > 0
