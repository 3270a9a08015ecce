"""The registered model queries run the default settings over the years of the data."""

from geoprev.plans import catalogue, model


def test_kalman_smooth_gives_all_weights_and_years(spark, sf_dir):
    years = {r.year for r in catalogue.surveys(spark, sf_dir).select("year").distinct().collect()}
    rows = catalogue.QUERIES["kalman_smooth"](spark, sf_dir).collect()
    s = model.Settings()
    keys = {(r.mutation, r.t, r.weight) for r in rows}
    assert {r.t for r in rows} == set(range(min(years), max(years) + 1)) and {r.weight for r in rows} == set(range(1, 2 * s.features + 1))
    assert len(rows) == len(keys) == len({r.mutation for r in rows}) * len({r.t for r in rows}) * 2 * s.features
    assert all(r.sd_weight > 0 for r in rows)


def test_settings_follow_the_data(spark):
    s = catalogue._settings(spark.createDataFrame([(1999,), (2003,)], "year int"))
    assert s == model.Settings(first_year=1999, last_year=2003)
