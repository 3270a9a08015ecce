import struct

import pytest
from pyspark.sql import functions as F

from geoprev.sources import shapefile, store


def test_cache_path():
    assert store.cache_path("k13:561:H", "full", "/d") == "/d/k13_561_H_full.rds"
    assert store.cache_path("a/b c", "x", "/d/", "parquet") == "/d/a_b_c_x.parquet"
    with pytest.raises(ValueError):
        store.cache_path("a", "x", "/d", "csv")


def test_observations(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("survey_id,study_id,collection_day,longitude,latitude,year,country_name,numerator,denominator,prevalence,mutation,more\n"
                 "1,s,2015-03-01,30.5,1,2015,A,2,10,20,k13:A,x\n2,s,not a day,NaN,1,2016,A,NA,10,,crt,y\n")
    rows = store.read_observations(spark, str(p)).orderBy("survey_id").collect()
    assert [str(r.collection_day) for r in rows] == ["2015-03-01", "None"]
    assert rows[1].longitude is None and rows[1].numerator is None and rows[0].year == 2015
    p.write_text("survey_id\n1\n")
    with pytest.raises(ValueError, match="missing"):
        store.read_observations(spark, str(p))


def test_model_tables(spark, tmp_path):
    d = spark.createDataFrame([("a:1", 1.0), ("b", 2.0)], "mutation string, v double")
    store.save_model({"surface": d}, str(tmp_path / "m"))
    assert store.load_model(spark, str(tmp_path / "m"), "surface", "a:1").first().v == 1
    for table, mutation in (("surface", "zzz"), ("none", "b")):
        with pytest.raises(FileNotFoundError):
            store.load_model(spark, str(tmp_path / "m"), table, mutation)


def test_csv_and_hyperparameters(spark, tmp_path):
    d = spark.createDataFrame([("a", None), ("b", 2.0)], "mutation string, ell_km double")
    path = store.save_csv(d, "t", str(tmp_path), missing="NA", append_date=True, gzip=True)
    assert path.endswith(".csv.gz")
    assert sorted((r[0], r[1]) for r in spark.read.csv(path, header=True).collect()) == [("a", "NA"), ("b", "2.0")]
    d.write.parquet(str(tmp_path / "h"))
    assert store.read_hyperparameters(spark, str(tmp_path / "h"), "b")["ell_km"] == 2
    with pytest.raises(ValueError):
        store.read_hyperparameters(spark, str(tmp_path / "h"), "c")


def write_shapefile(path, polygons, names):
    body = b""
    for i, rings in enumerate(polygons):
        pts = [p for r in rings for p in r]
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        rec = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    (path.parent / f"{path.stem}.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    head = struct.pack("<B3BIHH", 3, 124, 1, 1, len(names), 65, 11) + b"\0" * 20
    (path.parent / f"{path.stem}.dbf").write_bytes(head + field + b"\r" + b"".join(b" " + n.encode().ljust(10) for n in names))


def test_shapefile(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    write_shapefile(tmp_path / "w.shp", [[square], [square, square]], ["lake", "sea"])
    spark.dataSource.register(shapefile.ShapefileSource)
    rows = spark.read.format("shapefile").option("recordsPerTask", "1").load(str(tmp_path / "w.shp")).orderBy("record").collect()
    assert [(r.attributes["NAME"], len(r.rings)) for r in rows] == [("lake", 1), ("sea", 2)]
    assert [(p.x, p.y) for p in rows[0].rings[0]] == square


def test_schema(spark):
    from geoprev.schema import LONG_RASTER, require

    require(spark.createDataFrame([], LONG_RASTER), ["x", "p"])
    with pytest.raises(ValueError, match="missing"):
        require(spark.range(1).select(F.col("id")), ["x"])
