"""Whitening of embeddings by matrix-free block Lanczos.

Entries become whole numbers x = floor(scale * c) + shift, whose sums over the vectors are exact. The covariance is never
made: a pass over the vectors gives (X - mean)' (X - mean) Q for a block Q of a few directions, centred first as
(x - S div n) - (S mod n) / n, and partial products of tasks are added by a second, smaller set of tasks. The driver keeps
the basis (at most `span` directions of d numbers) and its products, orthogonalises every block twice against the whole basis
and solves the projected problem. Directions are done when their residual, made of the products themselves, is small;
a block that loses rank (an invariant subspace) goes on from new random directions, and a full basis restarts from
its best directions. A block is larger than the number of components, so equal eigenvalues are all found.

The trace of the covariance comes from the exact squared deviations of the vectors.

Defined results: vectors that are null or hold null or non-finite entries are left out, so are vectors whose length isn't the
commonest (of equally common ones the longest); components without variance are left out, so a single vector and equal vectors have none;
repeated rows and null identifiers count each; an empty table gives no rows; other columns are ignored.
Several passes read the vectors: give a table that is cheap to read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import bound_batches
from .vectors import lengths, matrix

#: Tasks that add up partial sums of the tasks before them.
ADDERS = 32


@dataclass
class Whitening:
    """n vectors; mean is whole + part / n in every dimension; components are columns, by falling variance."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    variance: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part / self.n

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.variance)


def numbers(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as whole numbers."""
    v = np.floor(scale * c)
    if len(v) and np.abs(v).max() >= 2.0**61:
        raise ValueError("an entry is too large to be a whole number of 64 bits")
    return v.astype(np.int64) + shift


def squared_deviations(x: np.ndarray, f: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of every row, exact."""
    a = x - f.whole
    top = f.n * (int(np.abs(a).max(initial=0)) + 1)
    if x.shape[1] * top * top < 2**62:
        m = f.n * a - f.part
        return (m * m).sum(1).tolist()
    if top < 2**52 and x.shape[1] <= 1024:  # in two halves
        m = f.n * a - f.part
        h, l = m >> 26, m & (2**26 - 1)
        return [(p << 52) + (q << 27) + r for p, q, r in zip((h * h).sum(1).tolist(), (h * l).sum(1).tolist(), (l * l).sum(1).tolist())]
    m = f.n * a.astype(object) - f.part.astype(object)
    return (m * m).sum(1).tolist()


def _summed(vectors: DataFrame, d: int, scale: int, shift: int, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple, kind=np.float64) -> np.ndarray:
    """The sum of kernel(x) over blocks of rows; added in the tasks, then in ADDERS tasks, then of at most so many on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, kind)
        for batch in batches:
            _, c = matrix(batch.column("v"), d)
            for k in range(0, len(c), 4096):
                total += kernel(numbers(c[k : k + 4096], scale, shift))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, kind), False
        for batch in batches:
            for p in batch.column("part").to_pylist():
                total, some = total + np.frombuffer(p, kind).reshape(shape), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = vectors.mapInArrow(part, "task long, part binary").repartition(ADDERS, "task").sortWithinPartitions("task").mapInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"], kind).reshape(shape) for r in parts.collect()), np.zeros(shape, kind))


def _orthogonal(z: np.ndarray, basis: np.ndarray, rng: np.random.Generator, tiny: float) -> tuple[np.ndarray, bool]:
    """Columns of z made orthonormal and orthogonal to the basis; those of no length are replaced by random ones (True if any)."""
    d, out, broke = len(z), basis, False
    for v in z.T:
        if out.shape[1] == d:
            break
        for attempt in range(20):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            if np.linalg.norm(v) > max(tiny, 1e-10 * size):
                break
            v, broke = rng.normal(size=d), True
        for _ in range(2):
            v = v / np.linalg.norm(v)
            v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :], broke


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int | None = None, span: int = 512, tolerance: float = 1e-13, max_passes: int = 500, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, their vectors and the number of products, of a symmetric non-negative matrix given by its products."""
    rng = np.random.default_rng(seed)
    want = min(want, d)
    block = min(d, block or want + 4)
    span = min(d, max(span, 4 * block))
    q, w, last = np.zeros((d, 0)), np.zeros((d, 0)), np.inf
    new, broke = _orthogonal(rng.normal(size=(d, block)), q, rng, 0.0)
    for passes in range(1, max_passes + 1):
        made = product(new)
        q, w = np.column_stack([q, new]), np.column_stack([w, made])
        t = q.T @ w
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        top = s[:, :want]
        scale = max(float(e[0]), 0.0)
        residual = np.linalg.norm(w @ top - (q @ top) * e[:want], axis=0)
        if q.shape[1] == d or len(e) >= want and not broke and (residual <= tolerance * scale).all():
            return e[:want], np.linalg.qr(q @ top)[0], passes
        settled = not broke and last < 2 * residual.max() and residual.max() <= 1e-11 * scale  # as near as rounding lets it come
        new, broke = _orthogonal(made, q, rng, 1e-14 * scale)
        if q.shape[1] + 2 * block > span and span < d:  # restart from the best directions
            if settled:
                return e[:want], np.linalg.qr(q @ top)[0], passes
            last = residual.max()
            keep = s[:, : want + block]
            q, w = q @ keep, w @ keep
    raise RuntimeError(f"the components did not settle in {max_passes} passes")


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, **lanczos) -> Whitening | None:
    """None if there is no vector."""
    if not (found := lengths(df, vec_col)):
        return None
    bound_batches(df.sparkSession)
    d, vectors = found[0], df.select(F.col(f"`{vec_col}`").alias("v"))
    one = lambda kernel, shape, kind=np.float64: _summed(vectors, d, scale, shift, kernel, shape, kind)
    # sums in two halves: they are exact for any number of vectors below 2^31
    sums = one(lambda x: np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(d, len(x))]), (3, d), np.int64)
    n = int(sums[2, 0])
    if n == 0:
        return None
    total = [(int(h) << 32) + int(l) for h, l in sums[:2].T]
    f = Whitening(n, np.array([t // n for t in total]), np.array([t % n for t in total]), np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0)

    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, c = matrix(batch.column("v"), d)
            yield pa.RecordBatch.from_arrays([pa.array([Decimal(sum(squared_deviations(numbers(c, scale, shift), f)))], pa.decimal128(38, 0))], names=["s"])

    squares = vectors.mapInArrow(deviations, "s decimal(38,0)").agg(F.sum("s").alias("s")).first()["s"]
    f.trace = float(int(squares or 0)) / float(n) ** 3
    if f.trace == 0:
        return f

    def product(q: np.ndarray) -> np.ndarray:
        def kernel(x: np.ndarray) -> np.ndarray:
            c = f.centred(x)
            return c.T @ (c @ q)

        return one(kernel, q.shape) / n

    e, v, f.passes = block_lanczos(product, d, components, **lanczos)
    some = e > 1e-12 * e[0]
    f.variance, f.components = e[some], v[:, some]
    f.components = f.components * np.sign(f.components[np.abs(f.components).argmax(0), np.arange(some.sum())])
    k = len(f.variance)

    def second_moments(x: np.ndarray) -> np.ndarray:
        y = np.column_stack([f.centred(x) @ f.scaled, np.ones(len(x))])
        return y.T @ y

    m = one(second_moments, (k + 1, k + 1)) / n
    f.identity_error = float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())
    return f


def whiten(df: DataFrame, f: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each vector that takes part and component."""
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    schema = StructType().add("vec_id", rows.schema["vec_id"].dataType)
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    k = 0 if f is None else len(f.variance)
    if k == 0:
        return df.sparkSession.createDataFrame([], schema)
    d = len(f.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = f.variance / f.trace
        for batch in batches:
            row, c = matrix(batch.column("v"), d)
            for at in range(0, len(row), 2048):
                x = numbers(c[at : at + 2048], scale, shift)
                m = len(x)
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, f.n), [Decimal(s) for s in squared_deviations(x, f) for _ in range(k)],
                           (f.centred(x) @ f.scaled).ravel(), np.tile(share, m), np.full(m * k, f.identity_error)]
                kinds = [pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.repeat(row[at : at + m], k))), *map(pa.array, columns, kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)
