"""EM for many mutations as rounds of aggregates.

A round turns the places of a mutation and year into sums (Phi' W Phi, Phi' W z, three numbers) at the present weights. Places
are dealt in parts of bounded size; a task holds the features of one block of them and one (2D)^2 sum, and parts are
added up by a tree of tasks. One task a mutation then goes through its years, one sum at a time: filter and smoother are
sequential, and keep a covariance a year. The smoothed weights, 2D numbers a mutation and year, come back to all tasks by a
broadcast of at most STATE bytes; mutations beyond that are fitted in further goes. Mutations whose years all have at most 2D places need no
sums: their places are less than the covariances that their task holds anyway, so it runs all rounds by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.obs import valid_counts
from ..shared import small_batches, stored
from . import kalman, rff
from .blas import one_thread

BLOCK = 2048  # places whose features are in memory at a time
PART = 1 << 16  # places of a task
FAN = 16  # sums that a task of the tree adds up
STATE = 128 << 20

SUMS = "mutation string, year int, part long, s binary, h binary, q double, log_w double, n long"


def places(obs: DataFrame, hyper: DataFrame, years: list[int]) -> DataFrame:
    """mutation, year, x_km, y_km, numerator, denominator, ell_km, tau2_year: counts of one place and year summed, which changes no result."""
    rows = valid_counts(obs).filter(F.col("year").between(years[0], years[-1]))
    rows = rows.groupBy("mutation", "year", "x_km", "y_km").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return rows.join(hyper.select("mutation", "ell_km", "tau2_year"), "mutation")


def _tasks(spark: SparkSession, groups: int) -> int:
    """Partitions for some long groups: twice as many, so that few meet in one."""
    return max(1, 2 * min(groups, 2 * spark.sparkContext.defaultParallelism))


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """From batches sorted by keys: each key with at most BLOCK of its rows."""
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        cut = np.flatnonzero(new)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(pdf)]):
            for k in range(s, e, BLOCK):
                part = pdf.iloc[k : min(e, k + BLOCK)]
                yield tuple(part[keys].iloc[0]), part


def sums_of_parts(batches: Iterator[pa.RecordBatch], omega: dict, state: dict, first_year: int) -> Iterator[tuple[tuple, kalman.Information]]:
    """(mutation, year, part) and its sums, from places sorted by these; omega and state (weights by year) by mutation."""
    at, total = None, None
    for key, d in _blocks(batches, ["mutation", "year", "part"]):
        if key != at:
            if at is not None:
                yield at, total
            at, total = key, kalman.Information.zero(2 * len(omega[key[0]]))
        phi = rff.features(d[["x_km", "y_km"]].to_numpy(float), omega[key[0]])
        y, n = d["numerator"].to_numpy(float), d["denominator"].to_numpy(float)
        w, z = kalman.pseudo(phi, y, n, state[key[0]][key[1] - first_year])
        total.add(phi, z, w)
    if at is not None:
        yield at, total


def _row(key: tuple, i: kalman.Information) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*key, i.s.tobytes(), i.h.tobytes(), i.q, i.log_w, i.n], kinds)], names=["mutation", "year", "part", "s", "h", "q", "log_w", "n"])


def _read(row: dict) -> kalman.Information:
    h = np.frombuffer(row["h"])
    return kalman.Information(np.frombuffer(row["s"]).reshape(len(h), -1).copy(), h.copy(), row["q"], row["log_w"], row["n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def added(sums: DataFrame, parts: int) -> DataFrame:
    """One row a mutation and year: parts are added FAN at a time, level by level."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for r in _rows(batches):
            key = (r["mutation"], r["year"], r["part"])
            if key != at:
                if at is not None:
                    yield _row(at, total)
                at, total = key, _read(r)
            else:
                total.merge(_read(r))
        if at is not None:
            yield _row(at, total)

    while parts > 1:
        keys = ["mutation", "year", "part"]
        sums = sums.withColumn("was", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        sums = sums.repartition(*keys).sortWithinPartitions(*keys, "was").drop("was").mapInArrow(add, SUMS)
        parts = math.ceil(parts / FAN)
    return sums


def em_in_memory(d: pd.DataFrame, omega: np.ndarray, tau2: float, years: list[int], rounds: int) -> kalman.Passes:
    """All rounds for one mutation with few places; the features of one year are made at a time."""
    by = dict(iter(d.sort_values(["year", "x_km", "y_km"]).groupby("year")))
    b = np.zeros((len(years), 2 * len(omega)))

    def said(i: int):
        if years[i] not in by:
            return None
        g = by[years[i]]
        phi = rff.features(g[["x_km", "y_km"]].to_numpy(float), omega)
        w, z = kalman.pseudo(phi, g["numerator"].to_numpy(float), g["denominator"].to_numpy(float), b[i])
        return kalman.said_by(phi, z, w)

    for r in range(rounds):
        p = kalman.filter_years(b.shape[1], map(said, range(len(years))), tau2)
        if r < rounds - 1:
            b = kalman.smoothed_means(p)
    return p


def em(obs: DataFrame, hyper: DataFrame, features: int, seed: int, years: list[int], rounds: int, finish: Callable[[str, float, kalman.Passes], pd.DataFrame], schema: str,
       part: int = PART, state_bytes: int = STATE) -> DataFrame:
    """finish(mutation, ell_km, last pass) of every mutation that has places and hyper-parameters, as rows of the schema.

    A row a mutation and year (its number of places) comes to the driver, and the smoothed weights of each round.
    """
    spark = obs.sparkSession
    small_batches(spark)
    rows = stored(places(obs, hyper, years), "em-places")
    sizes = rows.groupBy("mutation", "year", "ell_km", "tau2_year").count().collect()
    wide = sorted({r["mutation"] for r in sizes if r["count"] > 2 * features})
    narrow = {r["mutation"] for r in sizes} - set(wide)
    out = []
    if narrow:
        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            one_thread()
            ell, tau2 = float(pdf["ell_km"].iloc[0]), float(pdf["tau2_year"].iloc[0])
            return finish(pdf["mutation"].iloc[0], ell, em_in_memory(pdf, rff.frequencies(features, ell, seed), tau2, years, rounds))

        few = rows.filter(~F.col("mutation").isin(wide)) if wide else rows
        out.append(few.repartition(_tasks(spark, len(narrow)), "mutation").groupBy("mutation").applyInPandas(alone, schema))
    at_once = max(1, state_bytes // (len(years) * 2 * features * 8))
    for k in range(0, len(wide), at_once):
        some = set(wide[k : k + at_once])
        out.append(_rounds(rows, [r for r in sizes if r["mutation"] in some], features, seed, years, rounds, finish, schema, part))
    if not out:
        return spark.createDataFrame([], schema)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _rounds(rows: DataFrame, sizes: list, features: int, seed: int, years: list[int], rounds: int, finish: Callable, schema: str, part: int) -> DataFrame:
    spark = rows.sparkSession
    ell, tau2 = ({r["mutation"]: r[c] for r in sizes} for c in ("ell_km", "tau2_year"))
    omega = {m: rff.frequencies(features, e, seed) for m, e in ell.items()}
    parts = spark.createDataFrame([(r["mutation"], r["year"], -(-r["count"] // part)) for r in sizes], "mutation string, year int, parts long")
    most = max(-(-r["count"] // part) for r in sizes)
    keys = ["mutation", "year", "part"]
    dealt = rows.join(F.broadcast(parts), ["mutation", "year"]).select("mutation", "year", F.pmod(F.xxhash64("x_km", "y_km"), "parts").alias("part"), "x_km", "y_km", "numerator", "denominator")
    dealt = stored(dealt.repartition(*keys), "em-dealt")
    state = {m: np.zeros((len(years), 2 * features)) for m in ell}

    def run_filter(result: Callable, schema: str, sums: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            todo = _rows(batches)
            r = next(todo, None)
            while r is not None:
                mutation = r["mutation"]

                def said():
                    nonlocal r
                    for y in years:
                        if r is not None and (r["mutation"], r["year"]) == (mutation, y):
                            info, r = _read(r), next(todo, None)
                            yield info
                        else:
                            yield None

                p = kalman.filter_years(2 * features, said(), tau2[mutation])
                yield from result(mutation, p)

        return sums.repartition(_tasks(spark, len(ell)), "mutation").sortWithinPartitions("mutation", "year").mapInArrow(run, schema)

    def means(mutation: str, p: kalman.Passes) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([mutation]), pa.array([kalman.smoothed_means(p).tobytes()], pa.binary())], names=["mutation", "b"])

    def last(mutation: str, p: kalman.Passes) -> Iterator[pa.RecordBatch]:
        made = finish(mutation, ell[mutation], p)
        for i in range(len(made)):
            yield pa.RecordBatch.from_pandas(made.iloc[i : i + 1], preserve_index=False)

    for r in range(rounds):
        shared = spark.sparkContext.broadcast(state)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for key, total in sums_of_parts(batches, omega, shared.value, years[0]):
                yield _row(key, total)

        sums = added(dealt.repartition(*keys).sortWithinPartitions(*keys, "x_km", "y_km").mapInArrow(partial, SUMS), most)
        if r == rounds - 1:
            return run_filter(last, schema, stored(sums, "em-sums"))
        for got in run_filter(means, "mutation string, b binary", sums).collect():
            state = state | {got["mutation"]: np.frombuffer(got["b"]).reshape(len(years), -1)}
    raise ValueError("EM needs a round")
