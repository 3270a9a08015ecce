"""Arrays in chunks: slices give their cells and read their chunks only."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoprev.sources import arrays as A

CHUNK = (4, 3, 5)


@pytest.fixture(scope="module")
def array(spark, tmp_path_factory):
    """t 2015-2018, 10 x 7 cells, 11 draws; every seventh cell is missing."""
    path = str(tmp_path_factory.mktemp("array") / "a")
    df = spark.range(4 * 10 * 7 * 11).select((2015 + F.floor(F.col("id") / 770)).cast("int").alias("t"), F.floor(F.col("id") % 770 / 77).cast("int").alias("iy"),
                                            F.floor(F.col("id") % 77 / 11).cast("int").alias("ix"), (F.col("id") % 11).cast("int").alias("draw"), F.when(F.col("id") % 7 > 0, F.col("id") / 2).alias("p"))
    A.write_array(df.repartition(6), path, chunk=CHUNK)
    return path, [tuple(r) for r in df.filter("p IS NOT NULL").collect()]


@pytest.mark.parametrize("t,rows,columns,draws", [(None, None, None, None), ([2016], None, None, None), ([2015, 2018], (3, 5), (2, 2), (4, 10)), ([2017], (9, 9), (0, 6), (0, 0)), ([1900], None, None, None), (None, (20, 30), None, None)])
def test_slices(spark, array, t, rows, columns, draws):
    path, cells = array
    held = lambda v, limits: limits is None or limits[0] <= v <= limits[1]
    want = sorted(c for c in cells if (t is None or c[0] in t) and held(c[1], rows) and held(c[2], columns) and held(c[3], draws))
    assert sorted(map(tuple, A.read_array(spark, path, t, rows, columns, draws, CHUNK).collect())) == want
    some = A.chunks(spark, path, t, rows, columns, draws, CHUNK)
    blocks = {(c[0], c[1] // 4, c[2] // 3, c[3] // 5) for c in want}
    assert {(r.t, r.cy, r.cx, r.cd) for r in some.collect()} == blocks  # here every chunk that is met has cells of the slice
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert t is None or re.search(r"PartitionFilters: \[[^\]]*\bt#", plan)
    assert rows is None or "GreaterThanOrEqual(cy" in plan.split("PushedFilters")[1]


def test_folders_of_other_times_are_not_read(spark, array):
    path, _ = array
    files = A.chunks(spark, path, [2016], chunk=CHUNK).select(F.input_file_name()).distinct().collect()
    assert files and all("t=2016" in f[0] for f in files)


def test_cells_come_once(spark, tmp_path):
    twice = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 0, 2.0)], "t int, iy int, ix int, draw int, p double")
    with pytest.raises(PySparkException, match="comes twice"):
        A.write_array(twice, str(tmp_path / "x"))
