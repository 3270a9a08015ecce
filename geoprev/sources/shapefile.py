"""Shapefiles as a Spark data source: polygons of a .shp with the attributes of its .dbf.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").load("/path/water.shp")

One record a row: attributes as strings in a map, rings as arrays of points. The reader is split by record ranges; the
files are opened where the task runs, so they must lie in a folder that all executors see.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record int, attributes map<string,string>, rings array<array<struct<x: double, y: double>>>"
POLYGON_KINDS = (5, 15, 25)


def _attributes(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Field names and widths, bytes before the first record, bytes of a record."""
    with open(path, "rb") as f:
        head = f.read(32)
        start, size = struct.unpack("<HH", head[8:12])
        fields = []
        while (raw := f.read(32)) and raw[0] != 0x0D and len(raw) == 32:
            fields.append((raw[:11].split(b"\0")[0].decode("ascii", "replace"), raw[16]))
    return fields, start, size


def _offsets(path: str) -> list[int]:
    out, at = [], 100
    with open(path, "rb") as f:
        end = os.fstat(f.fileno()).st_size
        while at + 8 <= end:
            f.seek(at)
            _, words = struct.unpack(">ii", f.read(8))
            out.append(at)
            at += 8 + 2 * words
    return out


class Records(InputPartition):
    def __init__(self, first: int, offsets: list[int]):
        self.first, self.offsets = first, offsets


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[Records]:
        at = _offsets(self.path)
        return [Records(k, at[k : k + self.per_task]) for k in range(0, len(at), self.per_task)]

    def read(self, part: Records) -> Iterator[tuple]:
        dbf = os.path.splitext(self.path)[0] + ".dbf"
        fields, start, size = _attributes(dbf) if os.path.exists(dbf) else ([], 0, 0)
        with open(self.path, "rb") as shp, open(dbf if fields else self.path, "rb") as table:
            for i, at in enumerate(part.offsets, part.first):
                shp.seek(at)
                _, words = struct.unpack(">ii", shp.read(8))
                body = shp.read(2 * words)
                rings = []
                if struct.unpack("<i", body[:4])[0] in POLYGON_KINDS:
                    n, m = struct.unpack("<ii", body[36:44])
                    starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), m]
                    xy = struct.unpack(f"<{2 * m}d", body[44 + 4 * n : 44 + 4 * n + 16 * m])
                    rings = [[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
                values = {}
                if fields:
                    table.seek(start + i * size + 1)
                    for name, width in fields:
                        values[name] = table.read(width).decode("utf-8", "replace").strip()
                yield i, values, rings


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("recordsPerTask", "10000")))
