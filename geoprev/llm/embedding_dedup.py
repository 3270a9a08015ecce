"""Near-duplicates of embeddings by cosine: products of int8 tiles with error bounds, possible pairs checked in double precision.

A unit vector u is stored as s * q + e with q of int8. Then u.v and (s q).(s' q') differ by at most |e'| + |e| |s' q'|, numbers
that every vector carries, so no pair at or above the threshold is lost, and only pairs that the bound can't rule
out are computed again from the full vectors. Products of int8 are summed exactly (as floats, a thousand dimensions at a time).

Equal vectors are one row before that, with their number. Vectors are dealt to the nearest of some pivots (one for each `tile`
vectors, at most max_pivots) and crowded cells are cut into tiles. A vector meets the tiles of a cell only if it can
have a partner there: the angle to the pivot is at most the radius of the cell plus the angle of the threshold, and exceeds that
to its own pivot by at most twice the latter (v near u, u nearest to its pivot). Both are exact. Two tiles meet in one group, which holds
at most about two tiles of codes; the first round sends on which vectors of a group have possible partners, the second fetches their full
vectors and counts links. Pairs are never rows: a group sends for a vector the number of its links and one link to the least of what it reaches there.
On vectors without structure the angles rule little out, and the work grows with the square of the different vectors
divided by the cluster; that is what an exact answer costs there.

Defined results: vectors that are null, zero, empty or hold null or non-finite entries link with nothing; vectors of different lengths
don't link; repeated rows count each; a null identifier is kept, counts as a partner and names a component only if all identifiers of it are
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from .arrow import complete_groups
from .components import components
from .simhash import _stars
from .util import bound_batches, small, stored
from .vectors import lengths, matrix

#: Angles are compared with this much room for rounding (radians), approximate cosines with the other.
ANGLE_ROOM, ROOM = 1e-6, 1e-5


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the rows aren't zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    """u = scale * q + e by row: q as floats (whole numbers), scale, the length of scale * q, and that of e."""

    q: np.ndarray
    scale: np.ndarray
    size: np.ndarray
    error: np.ndarray

    def take(self, at) -> Codes:
        return Codes(self.q[at], self.scale[at], self.size[at], self.error[at])


def quantised(u: np.ndarray) -> Codes:
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    near = scale[:, None] * q
    return Codes(q.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(u - near, axis=1))


def possible(a: Codes, b: Codes, threshold: float, at_once: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """First row of a block of a, and by row of it and of b whether their cosine can reach the threshold."""
    step = max(1, at_once // max(1, len(b.q)))
    for k in range(0, len(a.q), step):
        own = a.take(slice(k, k + step))
        dot = own.q[:, :1024] @ b.q[:, :1024].T  # 1024 * 127 * 127 < 2^24: exact as floats
        for c in range(1024, a.q.shape[1], 1024):
            dot = dot.astype(np.float64) + own.q[:, c : c + 1024] @ b.q[:, c : c + 1024].T
        upper = dot * own.scale[:, None].astype(dot.dtype)
        upper *= b.scale.astype(dot.dtype)
        upper += own.error[:, None].astype(dot.dtype) * b.size.astype(dot.dtype)
        yield k, upper >= (threshold - ROOM - b.error).astype(dot.dtype)


def linked(u: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of u and v (same: v is u, each pair once) with a cosine of at least the threshold."""
    a, b = quantised(u), quantised(v)
    step = max(1, (1 << 21) // u.shape[1])
    for k, near in possible(a, b, threshold):
        i, j = np.nonzero(near)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            ok = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
            if ok.any():
                yield p[ok], q[ok]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _vectors(column, d: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)


def keyed(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, list[int], str]:
    """vec_id, uid (digest) and vec (its bytes) of every row, the latter null where it can't link; the lengths; the type of numbers."""
    sizes = lengths(df, vec_col)
    of = df.schema[vec_col].dataType
    kind = "<f4" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec: list = [None] * batch.num_rows
            for d in sizes:
                row, x = matrix(batch.column("v"), d)
                for i, one in zip(row.tolist(), (x + 0.0).astype(kind)):
                    if one.any():
                        vec[i] = one.tobytes()
            uid = [None if v is None else xxhash.xxh3_128_digest(v) for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(uid, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "uid", "vec"])

    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    return rows.mapInArrow(run, StructType().add("vec_id", rows.schema["vec_id"].dataType).add("uid", "binary").add("vec", "binary")), sizes, kind


@dataclass
class Cells:
    """Pivots, and of each cell the radius (-1 without vectors), the number of its tiles and that of its first tile."""

    pivots: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    angle: float

    def angles(self, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u @ self.pivots.T, -1, 1))

    def meets(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the cells in which it can have a partner."""
        at = self.angles(u)
        home = at.argmin(1)
        own = at[np.arange(len(u)), home][:, None]
        may = (self.radius >= 0) & (at <= self.radius + self.angle + ANGLE_ROOM) & (at - own <= 2 * self.angle + ANGLE_ROOM)
        may[np.arange(len(u)), home] = True
        return home, may


def cells(reps: DataFrame, n: int, d: int, kind: str, threshold: float, tile: int, max_pivots: int) -> Cells:
    """At most max_pivots pivots (and 32 MB of them), the vectors of the least hashes; one pass counts cells and finds their radius."""
    k = max(1, min(math.ceil(n / tile), max_pivots, (32 << 20) // (8 * d)))
    some = reps.select("vec", F.xxhash64(F.lit(3), "uid").alias("h"), "uid").orderBy("h", "uid").limit(k).collect()
    c = Cells(units(np.stack([np.frombuffer(r["vec"], kind) for r in some]).astype(np.float64)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), math.acos(threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, count = np.full(len(c.pivots), -1.0), np.zeros(len(c.pivots), np.int64)
        for batch in batches:
            x = _vectors(batch.column("vec"), d, kind)
            for at in range(0, len(x), 2048):
                a = c.angles(units(x[at : at + 2048]))
                home = a.argmin(1)
                np.maximum.at(top, home, a[np.arange(len(a)), home])
                count += np.bincount(home, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some]), pa.array(count[some])], names=["cell", "radius", "n"])

    found = reps.select("vec").mapInArrow(place, "cell long, radius double, n long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
    c.radius, c.parts = np.full(len(c.pivots), -1.0), np.zeros(len(c.pivots), np.int64)
    for r in found:
        c.radius[r["cell"]], c.parts[r["cell"]] = r["radius"], -(-r["n"] // tile)
    c.first = np.cumsum(c.parts) - c.parts
    return c


_GROUP = ["lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The rows of each group of two tiles that has any of both, and the places of those of the first and of the second."""
    for t in complete_groups(batches, _GROUP):
        lo, hi, tile = (t.column(c).to_numpy() for c in ("lo", "hi", "tile"))
        cut = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(lo)]):
            a, b = np.flatnonzero(tile[s:e] == lo[s]), np.flatnonzero(tile[s:e] == hi[s])
            if len(a) and len(b) and (e - s > 1):
                yield t.slice(s, e - s), a, b


def dealt(reps: DataFrame, c: Cells, d: int, kind: str, at_once: int = 1 << 15) -> DataFrame:
    """(lo, hi, tile, uid, codes, scale, size, error): each vector in each group of two tiles in which it can have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = int(c.parts.sum())
        cell = np.repeat(np.arange(len(c.parts)), c.parts)
        for batch in batches:
            x = _vectors(batch.column("vec"), d, kind)
            uid = batch.column("uid")
            part = np.frombuffer(b"".join(v[-8:] for v in uid.to_pylist()), "<u8")
            step = max(1, min(2048, at_once // tiles))
            for at in range(0, len(x), step):
                u = units(x[at : at + step])
                home, may = c.meets(u)
                code = quantised(u)
                own = c.first[home] + (part[at : at + step] % c.parts[home].astype(np.uint64)).astype(np.int64)
                row, other = np.nonzero(may[:, cell])
                mine = own[row]
                columns = [np.minimum(mine, other), np.maximum(mine, other), mine]
                bounds = [getattr(code, k)[row] for k in ("scale", "size", "error")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), uid.take(pa.array(row + at)), _binary(code.q.astype(np.int8)[row].view(np.uint8)), *map(pa.array, bounds)],
                                                 names=["lo", "hi", "tile", "uid", "codes", "scale", "size", "error"])

    return reps.select("uid", "vec").mapInArrow(run, "lo long, hi long, tile long, uid binary, codes binary, scale double, size double, error double")


def involved(tiles: DataFrame, d: int, threshold: float) -> DataFrame:
    """(lo, hi, tile, uid) of the vectors that can have a partner in a group, by the int8 product and its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _groups(batches):
            q = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(-1, d).astype(np.float32)
            code = Codes(q, *(t.column(k).to_numpy() for k in ("scale", "size", "error")))
            same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            some = np.zeros(len(q), bool)
            for k, near in possible(code.take(a), code.take(b), threshold):
                if same:
                    near[np.arange(len(near)), np.arange(k, k + len(near))] = False
                some[a[k : k + len(near)][near.any(1)]] = True
                some[b[near.any(0)]] = True
            if some.any():
                yield from t.select(["lo", "hi", "tile", "uid"]).filter(pa.array(some)).to_batches()

    return tiles.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "tile", "uid").mapInArrow(run, "lo long, hi long, tile long, uid binary")


def counted(wanted: DataFrame, reps: DataFrame, d: int, kind: str, threshold: float) -> DataFrame:
    """(uid, root, n): links of a vector inside a group, copies counted, and the first vector that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _groups(batches):
            u, mult = units(_vectors(t.column("vec"), d, kind)), t.column("mult").to_numpy()
            same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            n, label = np.zeros(len(u), np.int64), np.arange(len(u))
            for i, j in linked(u[a], u[b], threshold, same):
                i, j = a[i], b[j]
                np.add.at(n, i, mult[j])
                np.add.at(n, j, mult[i])
                new = label[i] != label[j]
                if new.any():
                    label = _stars(np.stack([label[i[new]], label[j[new]]]), len(u))[label]
            own = np.flatnonzero(n)
            uid = t.column("uid").combine_chunks()
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(own)), uid.take(pa.array(label[own])), pa.array(n[own])], names=["uid", "root", "n"])

    rows = reps.select("uid", "vec", "mult").join(small(wanted, 500_000), "uid").select(*_GROUP, "tile", "uid", "vec", "mult")
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "tile", "uid").mapInArrow(run, "uid binary, root binary, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tile: int = 4096, max_pivots: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs of rows with a cosine of at least the threshold (above 0)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = df.sparkSession
    bound_batches(spark)
    made, sizes, kind = keyed(df, id_col, vec_col)
    rows = stored(made, "vectors-keyed")
    reps = stored(rows.filter("uid IS NOT NULL").groupBy("uid", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("mult")), "vectors-distinct")
    found = None
    for d in sizes:
        own = reps.filter(F.octet_length("vec") == d * np.dtype(kind).itemsize)
        if n := own.count():
            wanted = stored(involved(dealt(own, cells(own, n, d, kind, threshold, tile, max_pivots), d, kind), d, threshold), "vectors-involved")
            part = stored(counted(wanted, own, d, kind, threshold), "vectors-links")
            found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], "uid binary, root binary, n long") if found is None else found
    label = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("uid").agg(F.sum("n").alias("n"))
    of = reps.select("uid", "first", "mult").join(links, "uid", "left").join(label.withColumnRenamed("node", "uid"), "uid", "left").select(
        "uid", "first", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "uid").alias("label"))
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    done = of.join(least, "label").select("uid", "n_links", "component_id")
    some = rows.filter("uid IS NOT NULL").select("vec_id", "uid").join(done.hint("merge"), "uid").select("vec_id", "n_links", "component_id")
    alone = rows.filter("uid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
