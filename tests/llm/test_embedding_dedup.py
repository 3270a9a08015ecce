import numpy as np
import pytest

from geoprev.llm import embedding_dedup as E
from geoprev.llm import queries

SCHEMA = "vec_id long, embedding array<{}>, label int, uid string, n_links string"


def plain(rows, threshold=0.95):
    """vec_id -> rows (n_links, component_id, kept), by all pairs."""
    def usable(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n, of = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    groups: dict = {}
    for i, (_, v) in enumerate(rows):
        if usable(v):
            groups.setdefault(len(v), []).append(i)
    for members in groups.values():
        u = np.array([rows[i][1] for i in members], float)
        u = u / np.abs(u).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= threshold
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            i, j = members[a], members[b]
            n[i] += 1
            n[j] += 1
            of[find(i)] = find(j)
    least: dict = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted(((vec_id, n[i], least.get(find(i)), vec_id == least.get(find(i))) for i, (vec_id, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def frame(spark, rows, kind="float"):
    rows = [(i, v, None, "x", "y") for i, v in rows]
    return spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)


def as_float(rows):
    return [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


@pytest.fixture(scope="module")
def rows():
    """Loose clusters, chains of near copies, a crowd of near copies, exact and scaled copies, odd vectors."""
    r = np.random.default_rng(4)
    out = []
    centres = r.normal(size=(6, 16))
    for i in range(400):
        out.append(centres[i % 6] * 1.2 + r.normal(size=16))
    for i in range(60):
        out.append(out[i] + r.normal(size=16) * r.choice([0.05, 0.2, 0.35]))
    crowd = r.normal(size=16)
    out += [crowd + 0.1 * r.normal(size=16) for _ in range(200)]
    out += [out[5] * 3, out[5] * -1, out[7], out[7], out[461], out[461] * 1e-20]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(out)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] * 16), (1004, [float("nan")] * 16), (1005, [float("-inf")] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-0.0, 1.0]), (1009, [0.0, 1.0]),
           (None, out[9].tolist()), (None, None), (None, [9.0] * 3), (3, out[20].tolist())]
    return rows + odd


def test_query_on_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = got(queries.op13_embedding_dedup(spark, sf_dir))
    assert out == plain(rows)


@pytest.mark.parametrize("kind,tile,max_pivots", [("float", 4096, 4096), ("double", 40, 4096), ("float", 16, 3), ("float", 64, 1)])
def test_on_brute_force(spark, rows, kind, tile, max_pivots):
    own = as_float(rows) if kind == "float" else rows
    assert got(E.near_vectors(frame(spark, own, kind), tile=tile, max_pivots=max_pivots)) == plain(own)


def test_other_thresholds_and_empty(spark, rows):
    own = as_float(rows)
    assert got(E.near_vectors(frame(spark, own), threshold=0.7, tile=50)) == plain(own, 0.7)
    assert E.near_vectors(frame(spark, [])).count() == 0
    assert got(E.near_vectors(frame(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError, match="threshold"):
        E.near_vectors(frame(spark, []), threshold=0)


def test_bounds_hold():
    r = np.random.default_rng(6)
    for d in (1, 3, 64, 1500):
        u = E.units(r.normal(size=(300, d)) * r.choice([1, 50], (300, d)))
        u[150:] = E.units(u[:150] + 0.35 / np.sqrt(d) * r.normal(size=(150, d)))
        true = u @ u.T
        near = np.concatenate([m for _, m in E.possible(E.quantised(u), E.quantised(u), 0.95, at_once=7000)])
        assert near[true >= 0.95].all()
        assert near.sum() < 3 * (true >= 0.95).sum() + 60  # and little else has to be looked at
        pairs = {(int(a), int(b)) for i, j in E.linked(u, u, 0.95, True) for a, b in zip(i, j)}
        assert pairs == {(a, b) for a, b in zip(*np.nonzero(np.triu(true >= 0.95, 1)))}
