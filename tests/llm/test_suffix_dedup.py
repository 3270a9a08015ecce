import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from geoprev.llm import suffix_dedup as S
from geoprev.llm.suffix_dedup import suffix_dedup

LENGTH = 72


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[k : k + length] for _, x in texts for k in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=repr)


def test_suffix_order():
    r = random.Random(1)
    for _ in range(30):
        raw = bytes(r.choice(b"\x01\x02\x03") for _ in range(r.randint(5, 200)))
        text = np.frombuffer(raw + bytes(24), np.uint8).copy()
        order = S.two_stage(text, np.arange(len(raw) + 1), 16)
        keys = [(raw + bytes(24))[i : i + 16] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(raw) + 1))


def test_repeated_starts():
    r = random.Random(2)
    for _ in range(60):
        pool = [bytes(r.choice(b"ab\xc3") for _ in range(r.randint(60, 140))) for _ in range(4)]
        parts = [b"".join(r.choice([*pool, b"a" * 90, bytes(r.choice(b"abc") for _ in range(30))]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))]
        count = Counter(p[i : i + LENGTH] for p in parts for i in range(len(p) - LENGTH + 1))
        want = [[count[p[i : i + LENGTH]] > 1 for i in range(len(p) - LENGTH + 1)] for p in parts]
        assert [x.tolist() for x in S.repeated(parts, LENGTH)] == want


def test_common_prefix():
    text = np.frombuffer(b"abcdefghXbcabcdefghYbc" + bytes(30), np.uint8).copy()
    assert S.common_prefix(text, np.array([0, 0]), np.array([11, 1]), 16).tolist() == [8, 0]


@pytest.fixture(scope="module")
def rows(words):
    r = random.Random(3)
    passage = " ".join(words(40, 777))
    out = [(i, " ".join(words(r.randint(5, 120), i))) for i in range(40)]
    out += [(100 + i, " ".join(words(10, 300 + i)) + " " + passage + " " + " ".join(words(8, 400 + i))) for i in range(25)]
    out += [(200 + i, out[i][1]) for i in range(5)] + [(210, out[3][1][7:])] + [(220, "ab" * 200), (221, "ñ" * 90), (222, None), (223, ""), (224, "x" * LENGTH), (None, passage), (225, out[8][1]), (225, out[8][1]), (225, "other")]
    return out


@pytest.mark.parametrize(("crowd", "broadcast"), [(1024, 64 << 20), (3, 64 << 20), (3, 0)])
def test_equals_brute_force(spark, rows, crowd, broadcast, monkeypatch):
    """A small crowd sends busy grams to the count by digest, in many buckets; broadcast 0 to joins that shuffle."""
    monkeypatch.setattr(S, "STRINGS", 500)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    assert got(suffix_dedup(df, LENGTH, crowd=crowd, broadcast_bytes=broadcast)) == plain(rows, LENGTH)


def test_known_digests():
    """Digests that begin alike are told apart."""
    known = np.array([[-5, 1], [3, 7], [3, 9], [8, 0]])
    assert S._among(np.array([[3, 9], [3, 8], [-5, 1], [9, 9], [8, 0], [-9, 0], [3, 7]]), known).tolist() == [True, False, True, False, True, False, True]
    assert S._among(np.zeros((2, 2), int), known[:0]).tolist() == [False, False]


def test_a_shared_digest_is_counted_before_the_shuffle(words):
    """One passage in many fragments: each of its strings leaves a task once, whatever the number of fragments."""
    passage = " ".join(words(30, 1)).encode()
    parts = [b"%04d" % i + passage[:LENGTH + 20] for i in range(500)]
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(parts, S.pa.binary()), S.pa.array([False] * 500)], names=["part", "full"])
    out = list(S._tally(LENGTH, 4)(iter([batch])))
    sent = np.concatenate([np.frombuffer(x, S.COUNTED) for b in out for x in b.column("strings").to_pylist()])
    assert sum(sent["n"] == 2) == 21 + 110 and len(sent) == 21 + 110 + 2 * 500  # the last digits repeat too


def test_edge_cases(spark, edge, empty):
    out = {r.doc_id: r for r in suffix_dedup(edge, 400).collect()}
    assert len(suffix_dedup(edge, 400).collect()) == edge.count()
    assert len(out[6].kept) == len("end") + 0 or out[6].n_bytes - len(out[6].kept) > 299_000
    assert out[1].n_bytes == 0 and out[8].spans == []
    assert suffix_dedup(empty, 400).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(edge, 10)
