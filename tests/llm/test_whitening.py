from fractions import Fraction

import numpy as np
import pytest

from geoprev.llm import queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=8):
    """(ids, n, deviations, whitened, explained) with a dense covariance."""
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in rows], n, deviation, c @ v / np.sqrt(e), e / float(Fraction(sum(deviation), n**3))


def check(got, rows, k=8, tolerance=1e-7):
    ids, n, deviation, white, explained = plain(rows, k)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(ids) * k and len(by) == len(got)
    for j in range(k):
        own = np.array([by[i, j + 1].whitened for i in ids])
        sign = np.sign(own @ white[:, j])
        assert np.abs(sign * own - white[:, j]).max() < tolerance
        assert by[ids[0], j + 1].explained == pytest.approx(explained[j], rel=1e-10)
    assert [int(by[i, 1].deviation) for i in ids] == deviation
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_on_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, sf_dir).collect(), rows)


def test_lanczos():
    rng = np.random.default_rng(1)
    for d, values in ((40, 2.0 ** -np.arange(40)), (300, np.r_[np.full(8, 5.0), np.linspace(1, 0, 292)]), (60, np.r_[3.0, 2, 1, np.zeros(57)]), (20, np.full(20, 7.0)), (600, np.linspace(2, 1, 600) ** 4), (3, [5.0, 1, 0]), (1, [2.0])):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        a = (q * values) @ q.T
        for span in (512, d // 2 if d > 100 else 60):  # the latter restarts
            e, v, passes = W.block_lanczos(lambda x: a @ x, d, 8, span=span)
            k = min(8, d)
            assert np.allclose(e, np.sort(values)[::-1][:k], atol=1e-12 * max(values)) and np.allclose(v.T @ v, np.eye(k), atol=1e-13)
            assert np.abs(a @ v - v * e).max() < 1e-12 * max(values) and passes <= 60


def test_exact_deviations():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (50, 5))
    for n in (50, 10**9, 10**13):  # one word, two halves, whole numbers of Python
        s = [int(t) * n // 50 + 7 for t in x.sum(0)]
        f = W.Whitening(n, np.array([t // n for t in s]), np.array([t % n for t in s]), None, None, 0.0, 0.0, 0)
        assert W.squared_deviations(x, f) == [sum((n * int(c) - t) ** 2 for c, t in zip(r, s)) for r in x]


def test_odd_tables(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 12)) * np.linspace(1, 0.1, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    odd = [(100, None), (101, []), (102, [None] * 12), (103, [float("nan")] + [0.0] * 11), (104, [float("inf")] * 12), (105, [1.0] * 5), (None, rows[0][1])]
    out = W.whiten(frame(spark, rows + odd + [(106, [0.0] * 12)]), W.fit(frame(spark, rows + odd + [(106, [0.0] * 12)]))).collect()
    check([x for x in out if x.vec_id is not None] + [x.__class__(**(x.asDict() | {"vec_id": -1})) for x in out if x.vec_id is None], rows + [(106, [0.0] * 12), (-1, rows[0][1])])
    for few in ([], odd[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):  # nothing, nothing of use, no variance
        df = frame(spark, few)
        assert W.whiten(df, W.fit(df)).collect() == []
    line = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(50)]  # one direction
    got = W.whiten(frame(spark, line), W.fit(frame(spark, line))).collect()
    check(got, line, 1)
