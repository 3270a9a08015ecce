"""Queries over surveys of all years, by brute force."""

import math
from collections import defaultdict

import pytest

from geoprev.plans import catalogue


@pytest.fixture(scope="module")
def pairs(spark, sf_dir):
    """(marker, row, row): distance, years apart, difference of logits; rows numbered by marker, year and nation."""
    rows = sorted(catalogue._placed(spark, sf_dir).collect(), key=lambda r: (r.mutation, r.year, r.id))
    out = {}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a.mutation == b.mutation:
                d = None if a.z is None or b.z is None else a.z - b.z
                out[a.mutation, i + 1, j + 1] = math.hypot(a.x_km - b.x_km, a.y_km - b.y_km), abs(a.year - b.year), d
    return out


def test_pairs_of_all_years(spark, sf_dir, pairs):
    got = {(r.mutation, r.ind1, r.ind2): r for r in catalogue.QUERIES["pair_distances"](spark, sf_dir).collect()}
    assert got.keys() == pairs.keys() and any(r.dist_time > 0 for r in got.values())
    for k, (d, t, z) in pairs.items():
        r = got[k]
        assert abs(r.dist_space - d) < 2e-6 and r.dist_time == t and (r.dist_z is None) == (z is None) and (z is None or abs(r.dist_z - z) < 2e-6)


def test_variogram_of_all_years(spark, sf_dir, pairs):
    cor = {(r.mutation, r.ind1, r.ind2): r.cor for r in catalogue.QUERIES["vario_cor"](spark, sf_dir).collect()}
    total, n = defaultdict(float), defaultdict(int)
    assert cor.keys() == pairs.keys()
    for k, (d, t, z) in pairs.items():
        rho = math.exp(-d / 300) * math.exp(-((t / 2) ** 2))
        assert abs(cor[k] - rho) < 2e-6
        if z is not None:
            c = 0.1 + 0.9 * (1 - rho)
            total[k[0]] -= 0.5 * (math.log(2 * math.pi * c) + z**2 / c)
            n[k[0]] += 1
    got = {r.mutation: r for r in catalogue.QUERIES["vario_loglike"](spark, sf_dir).collect()}
    assert got.keys() == total.keys()
    assert all(got[m].n_pairs == n[m] and abs(got[m].loglike - total[m]) < 1e-3 for m in total)


def test_positives_of_all_years(spark, sf_dir):
    rows = catalogue.surveys(spark, sf_dir).collect()
    some = {r.mutation for r in rows if r.prevalence > 44}
    got = catalogue.QUERIES["mutations_with_positives"](spark, sf_dir).collect()
    assert {(r.survey_id, r.mutation, r.year) for r in got} == {(r.survey_id, r.mutation, r.year) for r in rows if r.mutation in some}
    assert max(r.year for r in got) > 2016
