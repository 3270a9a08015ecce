"""The filter as a stream with a covariance in blocks, against the batch."""

import numpy as np
import pandas as pd

from geoprev.streaming import blocks as B

SCHEMA = "mutation string, year int, x_km double, y_km double, numerator double, denominator double"


def test_stream_equals_the_batch(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(f"m{i % 2}", int(2014 + i // 30), float(r.integers(0, 9) * 20), float(r.normal() * 50), float(r.integers(0, 9)), 20.0) for i in range(120)]
    rows = [x for x in rows if x[:2] != ("m1", 2015)] + [("m0", 2016, 1.0, 1.0, float("nan"), 5.0), ("m0", 2016, None, 1.0, 1.0, 5.0)]  # a year without surveys, rows of no use
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = [("m0", 2015, 5.0, 5.0, 1.0, 9.0), ("m1", 2013, 5.0, 5.0, 1.0, 9.0)]
    spark.conf.set(*B.PROVIDER)

    def run(new):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(files)
        stream = B.filtered(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files), 5, 60.0, 0.1, 2013, block=3)
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda d, i: d.write.mode("append").parquet(out)).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        run([x for x in rows if x[1] < 2016])
        run([x for x in rows if x[1] >= 2016] + late)  # another query goes on from the state
    finally:
        spark.conf.unset(B.PROVIDER[0])
    made = spark.read.schema(B.OUT).parquet(out)
    got = {(x.mutation, x.year): x for x in B.advanced(made).collect()}
    assert sorted(map(tuple, B.late(made).collect())) == [("m0", 2015, 1), ("m1", 2013, 1)]
    for m in ("m0", "m1"):
        want = B.filter_batch(pd.DataFrame([x for x in rows if x[0] == m], columns=["mutation", "year", "x_km", "y_km", "numerator", "denominator"]), 5, 60.0, 0.1, 2013)
        assert {y for k, y in got if k == m} == set(want)
        for y, (mean, c) in want.items():
            assert np.allclose(got[m, y].m, mean, atol=1e-9) and np.allclose(got[m, y].spread, np.diag(c), atol=1e-9)
