import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoprev.functions import exprs as X
from geoprev.functions import geo


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_emplogit(spark):
    r = one(spark, a=X.emplogit(F.lit(0.0), F.lit(10.0)), b=X.emplogit(F.lit(5.0), F.lit(10.0)), c=X.emplogit(F.lit(10.0), F.lit(10.0)), d=X.emplogit(F.lit(11.0), F.lit(10.0)))
    assert [r.a, r.b, r.c, r.d] == [pytest.approx(-3.044522437723423), 0, pytest.approx(3.044522437723423), None]


def test_vario_cor(spark):
    assert one(spark, a=X.vario_cor(F.lit(3.0), F.lit(2.0), 6, 4)).a == pytest.approx(0.4723665527)


def test_pg_weight(spark):
    r = one(spark, a=X.pg_weight(F.lit(10.0), F.lit(0.0)), b=X.pg_weight(F.lit(10.0), F.lit(-2.0)), c=X.pg_weight(F.lit(10.0), F.lit(-6.906754778648554)), d=X.pg_weight(F.lit(10.0), F.lit(float("nan"))))
    assert [r.a, r.b, r.c, r.d] == pytest.approx([2.5, 1.9039853899, 0.7224811304, 2.5])


@pytest.mark.parametrize(("year", "even", "odd"), [(2011, None, "2011-2012"), (2012, "2012-2013", "2011-2012"), (2023, "2022-2023", "2023-2024"), (2024, None, "2023-2024"), (2000, None, None), (2025, None, None), (None, None, None)])
def test_year_groups(spark, year, even, odd):
    y = F.lit(year).cast("int")
    r = one(spark, e=X.year_group(y), o=X.year_group(y, odd=True))
    assert (r.e, r.o) == (even, odd)


def test_labels(spark):
    r = one(spark, a=X.block_label(F.lit("k13:561:H")), b=X.map_title(F.lit("k13:comb")), c=X.area_title(F.lit("k13:comb")), d=X.map_title(F.lit("k13:561:H")), e=X.area_title(F.lit("k13:561:H")))
    assert tuple(r) == ("561H", "", "k13 combined", "k13 561H", "561H")


def test_nan_and_infinity(spark):
    r = one(spark, a=X.is_finite(F.lit(float("nan"))), b=X.is_finite(F.lit(float("inf"))), c=X.is_finite(F.lit(1.0)), d=X.is_finite(F.lit(None).cast("double")), e=X.no_nan(F.lit(float("nan"))), f=X.logit(F.lit(1.0)))
    assert tuple(r) == (False, False, True, False, None, None)


def test_plogis_is_stable(spark):
    r = one(spark, a=X.plogis(F.lit(-800.0)), b=X.plogis(F.lit(800.0)), c=X.plogis(F.lit(0.0)))
    assert tuple(r) == (0.0, 1.0, 0.5)


def test_vectors():
    assert X.buffer_vector([1, 2, 3], 2) == [-1, 0, 1, 2, 3, 4, 5]
    assert X.buffer_vector([1, 2, 3], 0) == [1, 2, 3]
    with pytest.raises(ValueError):
        X.buffer_vector([1, 1], 1)
    assert X.prev_vals() == [0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 1]
    assert X.axis_ticks(27.2, 44.4, 5) == [25, 30, 35, 40, 45]
    assert X.cell_area_km2((27, 44.5), (-5, 17.5), 200, 200) == pytest.approx(122.48186991853639)


def laea(spark, lon, lat, lon0, lat0):
    x, y = geo.laea_km(F.lit(float(lon)), F.lit(float(lat)), lon0, lat0)
    return tuple(one(spark, x=x, y=y))


def test_laea(spark, monkeypatch):
    assert laea(spark, 32, 4, 30, 1) == pytest.approx((222.1655037, 331.8093493))
    assert laea(spark, 28, -2, 30, 1) == pytest.approx((-222.5687792, -331.6694610))
    assert laea(spark, 30, 1, 30, 1) == pytest.approx((0, 0), abs=1e-9)
    x, y = laea(spark, 5, 50, 10, 52)  # a worked example of EPSG on a nearly equal ellipsoid, less its false origin
    assert (1000 * x + 4321000, 1000 * y + 3210000) == pytest.approx((3962799.45, 2999718.85), abs=0.01)


@pytest.mark.parametrize(("lon", "lat"), [(20, -30), (45, 17), (30, 0)])
def test_laea_keeps_areas(spark, lon, lat):
    h = 0.01
    p = [laea(spark, lon + a, lat + b, 33.0, 4.0) for a, b in ((0, 0), (h, 0), (h, h), (0, h))]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    cap = lambda d: geo._q(math.sin(math.radians(d)))
    assert area == pytest.approx((geo.A / 1000) ** 2 / 2 * math.radians(h) * (cap(lat + h) - cap(lat)), rel=1e-5)


def test_mercator_round_trip(spark):
    x, y = geo.mercator(F.lit(31.0), F.lit(-12.0))
    lon, lat = geo.from_mercator(x, y)
    assert tuple(one(spark, a=lon, b=lat)) == pytest.approx((31, -12))


def test_windows():
    assert geo.window_of("k13:561:H") == geo.Box(28, 32, -4, 0)
    with pytest.raises(ValueError, match="no map window"):
        geo.window_of("k13:999:X")


SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4)]]


def test_inside_counts_edges_and_holes():
    hole = SQUARE + [[(1, 1), (3, 1), (3, 3), (1, 3)]]
    assert geo.inside([2, 0, 4, 5, 2], [2, 2, 4, 2, 0.5], SQUARE).tolist() == [True, True, True, False, True]
    assert geo.inside([2, 2, 1], [2, 0.5, 2], hole).tolist() == [False, True, True]
    assert geo.inside([1], [1], []).tolist() == [False]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10)), min_size=3, max_size=8))
def test_clipped_rings_stay_in_the_box(ring):
    box = geo.Box(-2, 3, -1, 4)
    for x, y in geo.clip_ring(ring, box):
        assert box.xmin - 1e-9 <= x <= box.xmax + 1e-9 and box.ymin - 1e-9 <= y <= box.ymax + 1e-9


def test_clip_keeps_what_is_inside():
    assert sorted(geo.clip_ring([(0, 0), (4, 0), (4, 4), (0, 4)], geo.Box(1, 3, 1, 3))) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    assert geo.clip_ring([(0, 0), (1, 0), (1, 1)], geo.Box(5, 6, 5, 6)) == []
    assert np.allclose(geo.clip_ring([(0, 0), (1, 0), (1, 1)], geo.Box(-5, 6, -5, 6)), [(0, 0), (1, 0), (1, 1)])
