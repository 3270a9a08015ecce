from pyspark.sql import functions as F

from geoprev.streaming import filtering

SCHEMA = "mutation string, year int, x_km double, y_km double, numerator double, denominator double"


def test_stream_advances_year_by_year_and_marks_late_rows(spark, tmp_path):
    files, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).select(F.lit("m").alias("mutation"), (2015 + F.col("id") % 4).cast("int").alias("year"), F.col("id").cast("double").alias("x_km"), F.lit(0.0).alias("y_km"), (F.col("id") % 3).cast("double").alias("numerator"), F.lit(10.0).alias("denominator"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(files)
        q = (filtering.filter_stream(stream, 50.0, 0.1, features=4).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
             .foreachBatch(lambda d, i: d.write.mode("append").parquet(out)).trigger(availableNow=True).start())
        q.awaitTermination()

    rows.filter("year < 2017").write.mode("append").parquet(files)
    run()
    rows.filter("year >= 2017").unionByName(rows.filter("year = 2015").limit(3)).coalesce(1).write.mode("append").parquet(files)
    run()
    got = {r.year: (r.n_surveys, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {2015: (10, 0), 2016: (10, 0), 2017: (10, 3), 2018: (10, 3)}
