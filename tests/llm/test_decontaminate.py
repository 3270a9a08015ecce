import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoprev.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, n):
    wins = {}
    for name, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                wins.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for i, t in docs:
        w, hit, of = plain_words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if found := wins.get(tuple(w[k : k + size])):
                    of |= found - {"None"}
                    hit.update(range(k, k + size))
        out.append((i, len(w), len(hit), sorted(of)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data(words):
    items = [(i, " ".join(words(20, 900 + i))) for i in range(12)] + [(None, " ".join(words(20, 950))), (50, "Short ITEM"), (51, None), (52, "... !"), (53, " ".join(words(20, 900)))]
    docs = [(i, " ".join(words(80, i))) for i in range(60)]
    docs += [(100 + i, " ".join([*words(30, i), *words(20, 900 + i)[i % 5 : i % 5 + 14], *words(9, i + 1), "a short-item"])) for i in range(12)]
    docs += [(200, " ".join(words(20, 903)[:12])), (201, None), (202, ""), (203, " ".join(words(20, 904) + words(20, 905))), (203, " ".join(words(20, 904) + words(20, 905))), (204, " ".join(words(20, 950))), (None, "ÄÖ " + " ".join(words(20, 906)).upper())]
    return docs, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_hits_equal_brute_force(spark, data, block_bytes):
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.contamination(d, b, block_bytes=block_bytes).collect()]
    assert sorted(got, key=repr) == plain(docs, items, 13)


def test_edge_cases(spark, edge, empty):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "word word")], "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(edge, b).collect()}
    assert len(D.contamination(edge, b).collect()) == edge.count()
    assert got[8].n_hit == 6 and list(got[8]["items"]) == ["1"] and got[6].n_hit == 60_000 and got[1].n_words == 0
    assert D.contamination(empty, b).count() == 0
    assert {r.n_hit for r in D.contamination(edge, b.limit(0)).collect()} == {0}


def test_proximity():
    texts = [b"a x b x x c", b"b a", b"a x x x x x b", b""]
    v = D.Codes()
    seg = D.segment("s", [1, 2, 3, 4], texts, v)
    assert D.near(seg, [v[b"a"], v[b"b"]], 3) == [(0, 0), (1, 0)]
    assert D.near(seg, [v[b"a"], v[b"b"], v[b"c"]], 6) == [(0, 0)]
    assert D.near(seg, [v[b"a"], v[b"c"]], 2) == []


def test_proximity_matches(spark, edge, empty):
    docs = spark.createDataFrame([(1, "a x B x x c"), (2, "b, a!"), (3, "a x x x x x b"), (4, None)], "doc_id long, text string").repartition(2)
    q = spark.createDataFrame([(7, "A b"), (8, "..."), (9, None), (10, "c")], "item_id long, text string")
    got = sorted(map(tuple, D.proximity_matches(docs, q, 3).collect()))
    assert got == [(1, "10", 5), (1, "7", 0), (2, "7", 0)]
    assert D.proximity_matches(empty, q, 3).count() == 0 and D.proximity_matches(docs, q.limit(0), 3).count() == 0
    assert sorted(map(tuple, D.proximity_matches(docs, q, 3, block_bytes=2).collect())) == got


def test_phrases_do_not_cross_documents():
    for known in (None, {b"a", b"b"}):
        seg = D.segment("s", [1, 2], [b"x a", b"b a b"], D.Codes(known))
        assert (D.code(b"x") in seg["terms"]) == (known is None)
        phrase, at = D.search(seg, np.array([[0, 1], [0, 2]]), np.array([2, 2]), np.array([D.code(w) for w in (b"a", b"b", b"q")]))
        assert at.tolist() == [4] and phrase.tolist() == [0]


def test_one_index_for_any_number_of_blocks(spark, data, monkeypatch):
    built = []
    make = D.build_index
    monkeypatch.setattr(D, "build_index", lambda *a: built.append(1) or make(*a))
    docs, items = data
    out = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=400)
    assert len(built) == 1 and "PythonUDF" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_items_are_one(spark):
    """Repeated items fill no block, and blocks stay near their size."""
    many = spark.range(30_000).select(F.lit(1).alias("item_id"), F.lit("one two three four five").alias("text")).unionByName(
        spark.range(600).select((F.col("id") + 2).cast("int").alias("item_id"), F.concat(F.lit("item number "), F.col("id").cast("string")).alias("text")))
    blocks = [items for _, items in D._blocks(many, 2000)]
    assert len(blocks) > 3 and sum(map(len, blocks)) == 601 and max(map(len, blocks)) < 200
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "no item here"), (3, "item number 77")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in D.contamination(docs, many, block_bytes=4000).collect()}
    assert got == {1: (5, ["1"]), 2: (0, []), 3: (3, ["79"])}
