"""Spatial joins and masks over polygon tables (attributes, rings).

Polygons meet points by tiles. Rectangles go to the tiles of their box and are tested there; other polygons are cut into an index of
edges by tile (`tiles`), so a place meets the edges of its tile and rings stay where they are. No polygon table is collected; a
polygon's attributes come back by its number. Points on a shared border match every polygon that has it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import overlay
from ..functions.geo import Box, clip_ring, from_mercator, mercator
from ..shared import stored
from . import tiles


def with_box(polygons: DataFrame) -> DataFrame:
    xs, ys = (F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[k]))) for k in ("x", "y"))
    return polygons.withColumns({"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)})


def _tiled(polygons: DataFrame, size: float) -> DataFrame:
    p = with_box(polygons)
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return p.withColumn("tx", F.explode(steps("xmin", "xmax"))).withColumn("ty", F.explode(steps("ymin", "ymax")))


def candidates(points: DataFrame, polygons: DataFrame, keep: list[str], x: str, y: str, size: float) -> DataFrame:
    """Point rows with the polygons whose box holds them."""
    at = points.withColumn("tx", F.floor(F.col(x) / size)).withColumn("ty", F.floor(F.col(y) / size))
    boxes = _tiled(polygons, size).select("tx", "ty", "xmin", "xmax", "ymin", "ymax", "rings", *keep)
    return at.join(boxes, ["tx", "ty"]).filter(F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))).drop("tx", "ty", "xmin", "xmax", "ymin", "ymax")


def _numbered(polygons: DataFrame) -> DataFrame:
    """Polygons with a number (pid) each, written once so that it stays."""
    return stored(polygons.withColumn("pid", F.monotonically_increasing_id()), "polygons")


def spatial_join(points: DataFrame, polygons: DataFrame, keep: list[str], x: str = "x", y: str = "y", how: str = "inner", size: float | None = None, rectangles: bool = False) -> DataFrame:
    """Points with the attributes of each polygon that holds them; how='left' keeps unmatched points.

    Coordinates are tested once each, not once a row, and rows take the result by their coordinates; so how='left' needs
    no row number, which could differ between two evaluations of its input. rectangles: every polygon is its own bounding
    box, so the box test is the exact one and nothing leaves the JVM. size: of tiles; by default from the polygons.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    places = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(X.is_finite(F.col("_x")) & X.is_finite(F.col("_y"))).distinct()
    if rectangles:
        met = candidates(places, polygons, keep, "_x", "_y", size or 5.0).drop("rings")
    else:
        own = _numbered(polygons.select("rings", *keep))
        met = tiles.located(places, own.select("pid", "rings"), size).join(own.select("pid", *keep), "pid").drop("pid")
    return points.join(met, (points[x] == met["_x"]) & (points[y] == met["_y"]), how).drop("_x", "_y")


def mask(points: DataFrame, polygons: DataFrame, value: str = "p", x: str = "x", y: str = "y", size: float | None = None, rectangles: bool = False) -> DataFrame:
    """All rows; the value is NULL outside every polygon. Coordinates are tested once each, not once a row."""
    cells = points.select(x, y).distinct()
    held = spatial_join(cells, polygons, [], x, y, "inner", size, rectangles).select(x, y).distinct().withColumn("_in", F.lit(True))
    return points.join(held, [x, y], "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in").select(points.columns)


def clip(polygons: DataFrame, box: Box) -> DataFrame:
    """Rings cut to a rectangle; polygons of which nothing remains drop out."""
    keep = polygons.columns

    def cut(rings: list) -> list:
        return [c for c in (clip_ring([(p["x"], p["y"]) for p in r], box) for r in rings) if len(c) > 2]

    return _mapped(polygons, cut).select(keep)


def _mapped(polygons: DataFrame, change: Callable[[list], list]) -> DataFrame:
    """Polygons with other rings; those without any drop out. Rings go by Arrow: as pandas cells they would have to be of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("rings")
            rings = [change(r) if r is not None else [] for r in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(map(_as_rings, rings), b.schema.field(k).type)).filter(pa.array([len(r) > 0 for r in rings]))

    return polygons.mapInArrow(run, polygons.schema)


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def _as_rings(rings: list) -> list:
    return [[{"x": p[0], "y": p[1]} for p in r] for r in rings]


def repaired(polygons: DataFrame) -> DataFrame:
    """The same polygons with valid rings; polygons without an inside drop out."""

    return _mapped(polygons, overlay.repair)


def _united(polygons: DataFrame, keys: list[str], at_once: int = 32) -> DataFrame:
    """One polygon for each key: the union of its polygons, which a task takes some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind = None, [], None

        def made() -> pa.RecordBatch:
            columns = [pa.array([v], schema.field(c).type) for c, v in zip(keys, at)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([_as_rings(overlay.union(held))], kind)], names=[*keys, "rings"])

        for b in batches:
            schema = b.schema
            kind = b.schema.field("rings").type
            for key, rings in zip(zip(*(b.column(c).to_pylist() for c in keys)), b.column("rings").to_pylist()):
                if key != at:
                    if at is not None:
                        yield made()
                    at, held = key, []
                held.append(rings or [])
                if len(held) == at_once:
                    held = [overlay.union(held)]
        if at is not None:
            yield made()

    rows = polygons.select(*keys, "rings")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, rows.schema)


def dissolve(polygons: DataFrame, by: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """One polygon (by, rings) for the polygons of each group, or for all of them.

    Polygons are united tile by tile, then four tiles at a time up to one, so a group uses many tasks and borders inside a tile are gone before
    its polygon moves; the last task of a group has the borders of four quarters. levels: of halving the sides of the whole box; by default a
    tile has about 16 polygons. The box and the number of polygons come to the driver.
    """
    keys = by or ["_all"]
    rows = with_box(polygons if by else polygons.withColumn("_all", F.lit(0)))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1")).first()
    if levels is None:
        levels = min(10, max(0, math.ceil(math.log(max(1, r["n"]) / 16, 4))))
    side = [(r["x0"] or 0.0, ((r["x1"] or 0.0) - (r["x0"] or 0.0)) or 1.0), (r["y0"] or 0.0, ((r["y1"] or 0.0) - (r["y0"] or 0.0)) or 1.0)]
    cells = [F.coalesce(F.least(F.floor(((F.col(f"{c}min") + F.col(f"{c}max")) / 2 - low) / width * 2**levels), F.lit(2**levels - 1)).cast("long"), F.lit(0).cast("long")) for c, (low, width) in zip("xy", side)]
    out = rows.select(*keys, cells[0].alias("_cx"), cells[1].alias("_cy"), "rings")
    for _ in range(levels):
        out = _united(out, [*keys, "_cx", "_cy"]).withColumn("_cx", F.shiftright("_cx", 1)).withColumn("_cy", F.shiftright("_cy", 1))
    out = _united(out, keys)
    return out if by else out.drop("_all")


def intersect(polygons: DataFrame, others: DataFrame, keep: list[str], keep_others: list[str], size: float = 5.0) -> DataFrame:
    """(keep, keep_others, rings) for each pair of polygons that overlap; pairs meet on the tiles that both touch, by number, and then fetch their rings."""
    a, b = _numbered(polygons.select("rings", *keep)), _numbered(others.select("rings", *keep_others))
    met = _tiled(a, size).select("tx", "ty", F.col("pid").alias("_a"), "xmin", "xmax", "ymin", "ymax").join(
        _tiled(b, size).select("tx", "ty", F.col("pid").alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("xmin", "xmax", "ymin", "ymax")]), ["tx", "ty"])
    met = met.filter("xmin <= _xmax AND _xmin <= xmax AND ymin <= _ymax AND _ymin <= ymax").select("_a", "_b").distinct()
    pairs = met.join(a.withColumnRenamed("pid", "_a"), "_a").join(b.withColumnRenamed("rings", "_rings").withColumnRenamed("pid", "_b"), "_b").select(*keep, *keep_others, "rings", "_rings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [overlay.intersection([p, q]) for p, q in zip(x.column("rings").to_pylist(), x.column("_rings").to_pylist())]
            out = [*(x.column(c) for c in (*keep, *keep_others)), pa.array(map(_as_rings, made), x.schema.field("rings").type)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *keep_others, "rings"]).filter(pa.array([len(r) > 0 for r in made]))

    return pairs.mapInArrow(run, pairs.drop("_rings").schema)


def map_window(land: DataFrame, water: DataFrame | None = None, buffer_km: float = 200.0) -> dict:
    """Limits of a polygon table buffered in the metric projection, and land and water clipped to them.

    Six numbers come to the driver. mask: the union of the clipped land.
    """
    corners = with_box(land).select(F.explode(F.array(F.struct(F.col("xmin").alias("x"), F.col("ymin").alias("y")), F.struct(F.col("xmax").alias("x"), F.col("ymax").alias("y")))).alias("c"))
    x, y = mercator(F.col("c.x"), F.col("c.y"))
    e = extent(corners.select(x.alias("x"), y.alias("y")), "x", "y")
    d = 1000.0 * buffer_km
    lo, hi = from_mercator(F.col("xmin") - d, F.col("ymin") - d), from_mercator(F.col("xmax") + d, F.col("ymax") + d)
    row = e.select(lo[0].alias("a"), hi[0].alias("b"), lo[1].alias("c"), hi[1].alias("d")).first()
    if any(v is None for v in row):
        raise ValueError("the polygons have no extent")
    box = Box(*row)
    return {"box": box, "x_limits": (box.xmin, box.xmax), "y_limits": (box.ymin, box.ymax), "land": clip(repaired(land), box), "water": None if water is None else clip(repaired(water), box), "mask": dissolve(clip(repaired(land), box))}
