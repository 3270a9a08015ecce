"""An index of polygon edges by tile, so that a point meets the edges of its own tile and no ring travels with it.

Polygons are cut once into edges; an edge goes to the tiles that it passes. Of a tile that edges pass, the index has whether its
lower right corner is inside; of a tile that none passes, whether all of it is. A point is joined to that corner by a path
inside its tile: to the right side at its own height, then down. It is inside if the corner's side and the number of edges that the path
crosses say so; both are counted by the same half-open rules as a ray to the right, and whether an edge passes left of
the right side is decided once for both parts of the path, so the answer equals that of the whole ring. Points on an edge are inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_batches, stored

#: Places of a tile that meet its edges in one task.
CROWD = 1 << 16


def edges(polygons: DataFrame) -> DataFrame:
    """(pid, x1, y1, x2, y2) of polygons (pid, rings); open rings are closed, rings of fewer than three points left out."""
    rings = polygons.select("pid", F.explode("rings").alias("r")).filter(F.size("r") > 2)
    first, last = F.col("r")[0], F.element_at("r", -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("r")).otherwise(F.concat("r", F.array(first)))
    rings = rings.select("pid", closed.alias("r"))
    pair = F.arrays_zip(F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))
    out = rings.select("pid", F.explode(pair).alias("e"))
    return out.select("pid", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def tile_size(lines: DataFrame) -> float:
    """Some edges a tile, and about as many tiles without edges as there are edges; four numbers come to the driver."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    one = lines.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"), *[f(F.greatest(f"{c}1", f"{c}2") if f is F.max else F.least(f"{c}1", f"{c}2")).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"])
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    r = one.agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.sum(area).alias("area")).first()
    if not r["n"]:
        return 1.0
    return max(8 * r["length"] / r["n"], (r["area"] / (4 * r["n"])) ** 0.5) or 1.0


def _at(y: Column) -> Column:
    """Where the line of an edge has the height y."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def _tile(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def passed(lines: DataFrame, size: float) -> DataFrame:
    """Edges with the tiles (tx, ty) that they pass or touch; a little more than touch, for rounding."""
    room = 1e-9 * size
    low_y, high_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = lines.withColumn("ty", F.explode(F.sequence(_tile(low_y - room, size), _tile(high_y + room, size))))
    bottom, top = F.greatest(F.col("ty") * size - room, low_y), F.least((F.col("ty") + 1) * size + room, high_y)
    flat = F.col("y1") == F.col("y2")
    a, b = F.when(flat, F.col("x1")).otherwise(_at(bottom)), F.when(flat, F.col("x2")).otherwise(_at(top))
    low_x, high_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    slack = room + 1e-12 * (F.abs("x1") + F.abs("x2"))
    left, right = F.greatest(F.least(a, b), low_x) - slack, F.least(F.greatest(a, b), high_x) + slack
    return rows.withColumn("tx", F.explode(F.sequence(_tile(F.least(left, right), size), _tile(F.greatest(left, right), size))))


def corners(lines: DataFrame, size: float) -> DataFrame:
    """(pid, tx, ty, odd): whether the lower right corner of each tile of a polygon's box lies inside."""
    box = lines.groupBy("pid").agg(F.min(F.least("x1", "x2")).alias("x1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("y1", "y2")).alias("y2"))
    tiles = box.withColumn("ty", F.explode(F.sequence(_tile(F.col("y1"), size), _tile(F.col("y2"), size)))).select(
        "pid", "ty", F.explode(F.sequence(_tile(F.col("x1"), size) - 1, _tile(F.col("x2"), size))).alias("tx"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    heights = lines.withColumn("ty", F.explode(F.sequence(_tile(low, size), _tile(high, size))))
    y = F.col("ty") * size
    spans = heights.filter((F.col("y1") > y) != (F.col("y2") > y)).withColumn("x", F.least(F.greatest(_at(y), F.least("x1", "x2")), F.greatest("x1", "x2")))
    # the first tile whose right side is at or right of the crossing; sides are (tx + 1) * size, as the kernel has them
    first = _tile(F.col("x"), size)
    first = F.when(F.col("x") <= first * size, first - 1).when(F.col("x") <= (first + 1) * size, first).otherwise(first + 1)
    steps = spans.groupBy("pid", "ty", (first - 1).alias("tx")).agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    right = Window.partitionBy("pid", "ty").orderBy(F.col("tx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return tiles.join(steps, ["pid", "ty", "tx"], "left").select("pid", "tx", "ty", (F.coalesce(F.sum("k").over(right), F.lit(0)) % 2 == 1).alias("odd"))


def index(polygons: DataFrame, size: float | None = None) -> tuple[DataFrame, float]:
    """(tx, ty, pid, odd, x1, y1, x2, y2), and the size of tiles: a row an edge and tile, and a row without an edge for a tile inside."""
    lines = stored(edges(polygons), "polygon-edges")
    size = size or tile_size(lines)
    by_tile = stored(passed(lines, size), "polygon-tiles")
    sides = stored(corners(lines, size), "polygon-corners")
    crossed = by_tile.join(sides, ["pid", "tx", "ty"], "left").select("tx", "ty", "pid", F.coalesce("odd", F.lit(False)).alias("odd"), "x1", "y1", "x2", "y2")
    none = F.lit(None).cast("double")
    whole = sides.filter("odd").join(by_tile.select("pid", "tx", "ty").distinct(), ["pid", "tx", "ty"], "left_anti")
    return crossed.unionByName(whole.select("tx", "ty", "pid", "odd", *[none.alias(c) for c in ("x1", "y1", "x2", "y2")])), size


def holds(x: np.ndarray, y: np.ndarray, right: float, bottom: float, odd: bool, e: np.ndarray) -> np.ndarray:
    """Which points of a tile lie in a polygon; e: the polygon's edges that pass the tile (x1, y1, x2, y2), odd: its corner (right, bottom) is inside."""
    if len(e) == 0:
        return np.full(len(x), odd)
    x1, y1, x2, y2 = e.T[:, None, :]
    x, y = x[:, None], y[:, None]

    def left_of_side(at):
        """Whether edges span a height, and whether they do so at or left of the right side; where they do."""
        spans = (y1 > at) != (y2 > at)
        with np.errstate(divide="ignore", invalid="ignore"):
            where = x1 + (at - y1) * (x2 - x1) / (y2 - y1)
        left = spans & np.where((x1 <= right) & (x2 <= right), True, np.where((x1 > right) & (x2 > right), False, where <= right))
        return spans, left, where

    spans, left, where = left_of_side(y)
    spans0, left0, _ = left_of_side(np.full((1, 1), bottom))
    turns = (x1 > right) != (x2 > right)
    rising = (x2 > x1) == (y2 > y1)
    above = np.where(spans, left == rising, y1 > y)
    above0 = np.where(spans0, left0 == rising, y1 > bottom)
    inside = odd ^ ((left & (x < where)).sum(1) % 2 == 1) ^ ((turns & (above != above0)).sum(1) % 2 == 1)
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on = (cross == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    return inside | on.any(1)


def located(places: DataFrame, polygons: DataFrame, size: float | None = None, crowd: int = CROWD) -> DataFrame:
    """(_x, _y, pid) for each place (_x, _y: distinct, finite) and polygon (pid, rings) that holds it.

    Edges and places of a tile meet in one group, edges first; a crowded tile is dealt in parts, to which its edges go each.
    """
    small_batches(places.sparkSession)
    entries, size = index(polygons, size)
    tx, ty = _tile(F.col("_x"), size), _tile(F.col("_y"), size)
    none = F.lit(None).cast("double")
    at = places.select(tx.alias("tx"), ty.alias("ty"), "_x", "_y")
    crowded = at.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / crowd).alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = at.join(crowded, ["tx", "ty"], "left").select("tx", "ty", F.pmod(F.xxhash64("_x", "_y"), parts).alias("part"), F.lit(1).alias("kind"),
                                                          F.lit(None).cast("long").alias("pid"), F.lit(False).alias("odd"), F.col("_x").alias("x1"), F.col("_y").alias("y1"), none.alias("x2"), none.alias("y2"))
    wanted = entries.join(crowded, ["tx", "ty"], "left").select("tx", "ty", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), "pid", "odd", "x1", "y1", "x2", "y2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, made = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("tx", "ty", "part", "kind")], axis=1)
            pid, odd = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pid", "odd"))
            xy = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], axis=1)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                tile, kind = tuple(key[s, :3]), key[s, 3]
                if tile != at:
                    at, held, made = tile, [], None
                if kind == 0:
                    held.append((pid[s:e].astype(np.int64), odd[s:e].astype(bool), xy[s:e]))
                    continue
                if made is None:
                    made = _by_polygon(held)
                right, bottom = (tile[0] + 1) * size, tile[1] * size
                for p, inside, lines in made:
                    step = max(1, (1 << 19) // max(1, len(lines)))
                    for k in range(s, e, step):
                        x, y = xy[k : min(e, k + step), 0], xy[k : min(e, k + step), 1]
                        ok = holds(x, y, right, bottom, inside, lines)
                        if ok.any():
                            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok]), pa.array(np.full(ok.sum(), p))], names=["_x", "_y", "pid"])

    keys = ["tx", "ty", "part"]
    both = wanted.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return both.mapInArrow(run, "_x double, _y double, pid long")


def _by_polygon(held: list) -> list[tuple[int, bool, np.ndarray]]:
    if not held:
        return []
    pid, odd, lines = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(pid, kind="stable")
    pid, odd, lines = pid[order], odd[order], lines[order]
    cut = np.flatnonzero(np.append(True, pid[1:] != pid[:-1]))
    return [(int(pid[s]), bool(odd[s]), lines[s:e][~np.isnan(lines[s:e, 0])]) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(pid)])]
