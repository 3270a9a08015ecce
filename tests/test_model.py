import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoprev.plans import kalman, model, rff, simulate, variogram


def toy(seed, states=3, years=5):
    rng = np.random.default_rng(seed)
    omega = rff.frequencies(states, 100.0, seed)
    out = []
    for _ in range(years):
        n = rng.integers(0, 4)
        d = rng.integers(5, 40, n).astype(float)
        out.append(kalman.Year(rff.features(rng.normal(size=(n, 2)) * 100, omega), np.floor(d * rng.random(n)), d))
    return out


def pseudo(years):
    w = [kalman.pg_weights(y.n, np.full(len(y.n), kalman.Z0)) for y in years]
    return [(y.y - y.n / 2) / v - kalman.Z0 for y, v in zip(years, w)], w


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.01, 1.0))
def test_smoother_equals_gaussian_process(seed, tau2):
    years = toy(seed)
    if sum(len(y.y) for y in years) == 0:
        return
    target, w = pseudo(years)
    smooth, _ = kalman.rts_smoother(kalman.kalman_filter(years, target, w, tau2))
    assert np.allclose(smooth, kalman.gp_equivalent(years, target, w, tau2), atol=1e-8)


def test_filter_without_data_keeps_the_prior():
    years = [kalman.Year(np.zeros((0, 4)), np.zeros(0), np.zeros(0))] * 3
    p = kalman.kalman_filter(years, [np.zeros(0)] * 3, [np.zeros(0)] * 3, 0.5)
    assert np.allclose(p.m_filt, 0) and np.allclose(p.c_filt[2], 1.5 * np.eye(4)) and p.loglik == 0


def test_smoothed_covariance_shrinks():
    years = toy(4)
    target, w = pseudo(years)
    p = kalman.kalman_filter(years, target, w, 0.2)
    _, c = kalman.rts_smoother(p, covariances=True)
    assert all(np.trace(a) <= np.trace(b) + 1e-9 for a, b in zip(c, p.c_filt))


def test_paths_have_the_posterior_moments():
    years = toy(5)
    target, w = pseudo(years)
    p = kalman.kalman_filter(years, target, w, 0.2)
    m, c = kalman.rts_smoother(p, covariances=True)
    draws = kalman.posterior_paths(p, 20_000, 1)
    assert np.allclose(draws.mean(2), m, atol=0.03)
    assert np.allclose(np.cov(draws[1]), c[1], atol=0.03)


def test_em_runs_a_fixed_number_of_rounds():
    b, _, change = kalman.em(toy(6), 0.2, rounds=5)
    assert len(change) == 5 and change[-1] < change[0] and np.isfinite(b).all()


def test_features_approach_the_kernel():
    xy = np.random.default_rng(0).normal(size=(30, 2)) * 50
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    error = [np.abs(f @ f.T - rff.squared_kernel(d, 60.0)).mean() for f in (rff.features(xy, rff.frequencies(n, 60.0, 1)) for n in (50, 5000))]
    assert error[1] < error[0] / 4 and error[1] < 0.02
    f = rff.features(xy, rff.halton_frequencies(2000, 60.0))
    assert np.abs(f @ f.T - rff.squared_kernel(d, 60.0)).mean() < 0.02


def test_prototypes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.01 * rng.normal(size=60)
    assert np.allclose(rff.least_squares(x, y), [1, -2, 0.5], atol=0.02)
    assert np.allclose(rff.ridge_cv(x, y)[1], [1, -2, 0.5], atol=0.05)
    mean, cov = rff.bayes_linear(x, y, 1e-4, 10.0)
    draws = rff.bayes_draws(x[:2], mean, cov, 4000, rng)
    assert np.allclose(draws.mean(1), y[:2], atol=0.05)
    k = rff.squared_kernel(np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0))), 2.0)
    s = np.array([rff.gp_sample(k, rng) for _ in range(4000)])
    assert np.allclose(np.cov(s.T), k, atol=0.1)


def test_variogram_fit_recovers_parameters():
    h = np.arange(12.5, 1000, 25.0)
    gamma = 0.8 + 0.6 * (1 - np.exp(-((h / 300) ** 2)))
    assert variogram.fit_gaussian(h, gamma, np.full(len(h), 50.0)) == pytest.approx((0.6, 300), rel=1e-3)
    with pytest.raises(ValueError):
        variogram.fit_gaussian(np.array([0.0]), np.array([1.0]), np.array([1.0]))


SMALL = model.Settings(features=6, rounds=2, draws=30, first_year=2014, last_year=2017, nx=6, ny=5, block=7)


def test_surface_and_regions(spark):
    obs = spark.range(60).select(F.lit("m").alias("mutation"), (2014 + F.col("id") % 4).cast("int").alias("year"), (F.col("id") * 13 % 200).cast("double").alias("x_km"), (F.col("id") * 7 % 150).cast("double").alias("y_km"), (F.col("id") % 5).cast("double").alias("numerator"), F.lit(20.0).alias("denominator"))
    fits = model.fit_models(obs, spark.sql("SELECT 'm' AS mutation, 80D AS ell_km, 0.1D AS tau2_year"), SMALL)
    from geoprev.functions.geo import Box

    cells = model.prediction_cells(spark, Box(30, 31, 0, 1), SMALL, (30.5, 0.5)).withColumn("id_1", (F.col("pixel") % 2).cast("string"))
    out = model.surface(fits, cells, SMALL).toPandas()
    assert len(out) == 4 * 30
    assert ((out["mean"] > 0) & (out["mean"] < 1)).all() and (out["ci_width"] >= 0).all()
    assert (out["ex_1"] >= out["ex_5"]).all() and (out["ex_5"] >= out["ex_10"]).all()
    regions = model.region_draws(fits, cells, SMALL).groupBy("id_1", "t").agg(F.avg("mean_p").alias("p")).toPandas()
    means = out.assign(id_1=(out.pixel % 2).astype(str)).groupby(["id_1", "t"])["mean"].mean()
    assert np.allclose(regions.set_index(["id_1", "t"])["p"].sort_index(), means.sort_index())


def test_simulated_field_matches_its_covariance():
    x = list(range(12))
    f = np.stack([simulate.sim_array(x, x, x, 2.0, 2.0, seed=s) for s in range(60)])
    assert f.mean() == pytest.approx(0, abs=0.15)
    assert f.var() == pytest.approx(1, rel=0.2)
    near = (f[:, 1:, :, :] * f[:, :-1, :, :]).mean() / f.var()
    assert near == pytest.approx(np.exp(-1 / 8), abs=0.08)


def test_injected_noise_and_errors():
    x = [0.0, 1.0, 2.0]
    noise = np.random.default_rng(1).normal(size=(5, 5, 5))
    a = simulate.sim_array(x, x, x, 1.0, 1.0, noise=noise, buffers=(1, 1, 1))
    assert np.allclose(simulate.sim_array(x, x, x, 1.0, 1.0, noise=2 * noise, buffers=(1, 1, 1), mu=1.0), 2 * a + 1)
    with pytest.raises(ValueError):
        simulate.sim_array(x, x, x, 1.0, 1.0, space="Other")


def test_surveys_are_repeatable(spark):
    f = simulate.sim_field(spark, [0, 1, 2], [0, 1, 2], [0, 1], [1], length_space=1.0, length_time=1.0, buffers=(2, 2, 2))
    a, b = (sorted(map(tuple, simulate.draw_surveys(f, 9, 30, seed=4).collect())) for _ in range(2))
    assert a == b and len(a) == 9 and all(0 <= r[6] <= 30 for r in a)
    with pytest.raises(ValueError):
        simulate.draw_surveys(f, 99, 30)


def test_information_form_equals_the_solve_in_surveys():
    """Years of more surveys than weights, in one go and some at a time."""
    rng = np.random.default_rng(3)
    omega = rff.frequencies(3, 100.0, 1)
    years = [kalman.Year(rff.features(rng.normal(size=(n, 2)) * 100, omega), np.floor(20 * rng.random(n)), np.full(n, 20.0)) for n in (40, 0, 3, 25)]
    target, w = pseudo(years)
    p = kalman.kalman_filter(years, target, w, 0.3)
    smooth, _ = kalman.rts_smoother(p)
    assert np.allclose(smooth, kalman.gp_equivalent(years, target, w, 0.3), atol=1e-7)
    at, phi = np.repeat([1, 2, 3, 4], [40, 0, 3, 25]), np.concatenate([y.phi for y in years])
    k = 0.3 * np.minimum(at[:, None], at[None]) * (phi @ phi.T) + np.diag(1 / np.concatenate(w))
    z = np.concatenate(target)
    assert p.loglik == pytest.approx(-0.5 * (np.linalg.slogdet(k)[1] + z @ np.linalg.solve(k, z) + len(z) * np.log(2 * np.pi)))
    whole, cut = (kalman.information(years[0], target[0], w[0], n) for n in (4096, 7))
    assert np.allclose(whole.s, cut.s) and np.allclose(whole.h, cut.h) and whole.q == pytest.approx(cut.q) and whole.n == cut.n == 40


def test_surface_plan_has_no_product(spark, monkeypatch):
    """Cells are broadcast in slices, whatever their number; results don't depend on the slices."""
    from geoprev.functions.geo import Box

    obs = spark.range(20).select(F.substring(F.concat(F.lit("m"), "id"), 1, 1).alias("mutation"), F.lit(2014).alias("year"), (F.col("id") * 3.0).alias("x_km"), (F.col("id") * 2.0).alias("y_km"), F.lit(2.0).alias("numerator"), F.lit(20.0).alias("denominator"))
    fits = model.fit_models(obs, spark.createDataFrame([("m", 80.0, 0.1)], "mutation string, ell_km double, tau2_year double"), SMALL)
    cells = model.prediction_cells(spark, Box(30, 31, 0, 1), SMALL, (30.5, 0.5))
    one = model.surface(fits, cells, SMALL)
    monkeypatch.setattr(model, "SLICE", 7)
    many = model.surface(fits, cells, SMALL)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    a, b = (d.toPandas().sort_values(["t", "pixel"]).reset_index(drop=True) for d in (one, many))
    assert len(a) == 4 * 30 and np.allclose(a.drop(columns="mutation"), b.drop(columns="mutation"))
    assert model.surface(fits, cells.filter("pixel < 0"), SMALL).count() == 0
