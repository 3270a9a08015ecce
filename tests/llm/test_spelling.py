import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geoprev.llm import queries, spelling, trie

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, every=97, least=5, least_n=3):
    """word -> (form, root, n, n_near, form_n), by comparing all pairs of words."""
    n = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= least_n}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("letters,longest,words", [("ab", 4, 20), ("abc", 7, 60), ("abcé", 9, 60), ("azÀÿ÷", 12, 60), ("a", 30, 25)])
def test_trie_on_brute_force(letters, longest, words):
    r = random.Random(longest)
    for _ in range(20):
        held = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(r.choice([0, 1, 2, words]))})
        asked = [*held, *("".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(20))]
        t = trie.Trie.loads(trie.build(held, np.arange(len(held))).dumps())
        assert t.words(np.arange(len(held))) == held
        row, word = trie.neighbours(t, *trie.encode(asked), at_once=50)
        assert sorted(zip(row.tolist(), word.tolist())) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(held) if a != b and one_apart(a, b)]


def test_query_on_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = sorted(rows)[:25]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert len(want) > 100 and any(v[0] for v in want.values())
    assert got(spelling.variants(df, every=97)) == want
    assert got(spelling.variants(df.repartition(7), every=97, shard_words=150, broadcast_rows=3)) == want  # many tries, joins by shuffle
    assert got(spelling.variants(df, every=97, shard_letters=999)) == want
    assert got(spelling.variants(df)) == plain(rows, 0)


def test_whole_query(spark, sf_dir):
    """The registered query on the whole table; counts of all words, and neighbours of a sample against all words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = got(queries.op11_spelling(spark, sf_dir))
    n = {}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    assert {w: v[2] for w, v in out.items()} == n
    for w in random.Random(3).sample(sorted(n), 60):
        near = [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_apart(w, v)]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        assert out[w][3] == len(near) and out[w][0] == (best if best and n[best] >= 2 * n[w] else None)
        assert out[w][1] == (out[out[w][0]][1] if out[w][0] else w)


def test_chains_ties_and_odd_tables(spark, edge, empty):
    chain = {"aaaaab": 3, "aaaabb": 6, "aaabbb": 12, "aabbbb": 24, "abbbbb": 48, "ÀÉÿ÷x": 3, "ÀÉÿ÷y": 6, "ÀÉÿ÷z": 6}
    text = " ".join(w for w, k in chain.items() for _ in range(k))
    out = got(spelling.variants(spark.createDataFrame([(None, text), (None, None), (1, ""), (2, "Aaaaab, AAAABB!")], "doc_id long, text string"), every=0))
    assert out["aaaaab"] == (None, "aaaaab", 4, 1, None) and out["aaaabb"] == (None, "aaaabb", 7, 2, None)  # 4 and 7, 7 and 12
    assert out["aaabbb"] == ("aabbbb", "abbbbb", 12, 2, 24) and out["aabbbb"][:2] == ("abbbbb", "abbbbb")
    assert out["ÀÉÿ÷x"] == ("ÀÉÿ÷y", "ÀÉÿ÷y", 3, 2, 6)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(spelling.variants(edge, every=97)) == plain(rows)
    assert spelling.variants(empty).count() == 0
    long = "x" * 10_000  # a run of ten thousand letters, and two that differ from it in one
    docs = spark.createDataFrame([(i, f"{long} {long[:5_000]}y{long[5_001:]} {long}x") for i in range(3)], "doc_id long, text string")
    assert {(len(w), v[3]) for w, v in got(spelling.variants(docs)).items()} == {(10_000, 2), (10_000, 1), (10_001, 1)}


def test_slices_of_batches(spark):
    """Texts without nulls whose batch is cut into slices: Arrow's ascii_lower errs on a slice that was cast."""
    texts = pa.array(["", "Alphas beta", "GAMMA delta delta", "é"])
    t = spelling._counted(pa.array(["1", "2"]), texts.slice(2, 2), 5, 0)
    assert dict(zip(t["word"].to_pylist(), t["n"].to_pylist())) == {"gamma": 1, "delta": 2}
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abÀ") for _ in range(r.randint(4, 7))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(180_000)) + f" Only{chr(97 + i)} " * 3) for i in range(9)]  # over 8 MB: a batch and a bit
    assert sum(len(t.encode()) for _, t in rows) > 9 << 20
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), every=97)) == plain(rows)
