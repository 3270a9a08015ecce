from collections import defaultdict

import pytest

from geoprev.llm.exact_dedup import dedup_state, exact_dedup


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return groups


@pytest.mark.parametrize("digest", ["sha2({}, 256)", "cast(length({}) % 3 as string)"])
def test_groups_survive_any_digest(spark, edge, tmp_path, digest):
    """The second digest collides all the time: hits are told apart by their bytes."""
    path = str(tmp_path / "d.parquet")
    edge.write.parquet(path)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = exact_dedup(spark, path, digest=digest).collect()
    assert len(got) == len(rows)
    groups = expected(rows)
    sizes = sorted(len(g) for g in groups.values() for _ in g)
    assert sorted(r.group_size for r in got) == sizes
    assert sum(r.kept for r in got) == len(groups)
    best = {max((i for i in g if i is not None), default=None) for g in groups.values()}
    assert {r.keep_id for r in got} == best
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].keep_id == 9 and by_id[4].keep_id == 5 and by_id[6].keep_id == 7 and by_id[1].keep_id == 2 and by_id[3].keep_id == 3


def test_state_takes_only_new_files(spark, tmp_path):
    path, ckpt = str(tmp_path / "d.parquet"), str(tmp_path / "c")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make([(1, "a"), (2, "b")]).write.parquet(path)
    assert {r.keep.doc_id: r.group_size for r in dedup_state(spark, path, ckpt).collect()} == {1: 1, 2: 1}
    make([(3, "A"), (4, "c")]).write.mode("append").parquet(path)
    assert {r.keep.doc_id: r.group_size for r in dedup_state(spark, path, ckpt).collect()} == {3: 2, 2: 1, 4: 1}


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


@pytest.mark.parametrize("name", ["a{b,c}[1]*?d", "plain.parquet", "ends]"])
def test_odd_paths_and_single_files(spark, tmp_path, name):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "doc_id long, text string").coalesce(1)
    rows.write.parquet(str(tmp_path / "plain"))
    (tmp_path / "plain").rename(tmp_path / name)
    (tmp_path / "ab").mkdir()
    for path in [tmp_path / name, *(tmp_path / name).glob("part-*.parquet")]:
        assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(spark, str(path)).collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
