import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from geoprev.llm import token_store as S
from geoprev.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


ALPHABET = st.sampled_from(list("abcXYZ019 .,'!<|>\t\n \u0085\x1c\x02éÉ́̌JİKſñ漢字🙂") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "...", "J̌"])


@settings(max_examples=300, deadline=None)
@example(["İ...", "क़.", "שׁ,", "ñ.", "ŉ!", "Ǆ."])
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=4))
def test_words_give_the_ids_of_whole_texts(tokenizer, texts):
    e = S.WordEncoder.of(word_tokenizer(), 2)
    ids, counts = e.encode(S.pa.array(["ÄÖÜ before", *texts]).slice(1))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(tokenizer, words, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 300)
    e = S.WordEncoder(word_tokenizer(), 2)
    for i in range(12):
        texts = [" ".join(words(90, 10 * i + k)) + ", 42!" for k in range(3)]
        ids, counts = e.encode(S.pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def expected(tokenizer, rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_round_trip(spark, tokenizer, words, edge):
    rows = [(i, " ".join(words(400, i % 7) + words(50, i))) for i in range(60)] + [(r.doc_id if r.doc_id is None else 1000 + r.doc_id, r.text) for r in edge.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = S.write_store(docs, word_tokenizer())
    want = expected(tokenizer, rows)
    assert sorted(map(tuple, S.checksums(spark, path).collect()), key=lambda r: r[1]) == want
    ids = {r.start: r.ids for r in S.read_ids(spark, path).collect()}
    assert all(zlib.crc32(np.array(ids[at], "<u4").tobytes()) == crc for _, at, _, crc in want)
    some = S.read_ids(spark, path, spark.createDataFrame([(3,)], "doc_id long")).collect()
    assert [r.doc_id for r in some] == [3]
    names = [bytes(r.digest) for r in S.chunks(spark, path).collect()]
    used = [bytes(d) for r in S.recipes(spark, path).collect() for d in r.digests]
    assert len(names) == len(set(names)) == len(set(used)) < len(used)  # shared passages are stored once


def test_damage_is_found(spark, tmp_path):
    path = S.write_store(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), word_tokenizer(), path=str(tmp_path / "s"))
    kept = S.chunks(spark, path).collect()
    spark.createDataFrame([(bytes(r.digest), r.n, S.zstandard.compress(b"\0\0")) for r in kept], "key binary, n int, data binary").selectExpr("key", "n", "data", "'chunk' kind").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows")
    with pytest.raises(Exception, match="digest"):
        S.checksums(spark, path).collect()


@pytest.mark.parametrize("part", ["doc_id", "start", "n_tokens", "digests", "root", "manifest", "store root", "lost recipe"])
def test_damage_of_recipes_and_tree_is_found(spark, tmp_path, monkeypatch, words, part):
    """Three levels of nodes; each kind of damage stops every way of reading."""
    monkeypatch.setattr(S, "FANOUT", 4)
    path = S.write_store(spark.createDataFrame([(i, " ".join(words(5, i))) for i in range(30)], "doc_id long, text string").repartition(3), word_tokenizer(), path=str(tmp_path / "s"))
    levels = sorted((tmp_path / "s" / "manifest").glob("level=*"))
    assert len(levels) == 3 and S.checksums(spark, path).count() == 30
    hit = S.F.col("index") == 7
    kept = spark.read.parquet(f"{path}/recipes")
    if part == "manifest":
        rows = spark.read.schema(S.NODE).parquet(str(levels[1])).collect()
        spark.createDataFrame([(r.node, bytes(32) if r.node == 0 else bytes(r.root)) for r in rows], S.NODE).write.mode("overwrite").parquet(str(levels[1]))
    elif part == "store root":
        r = spark.read.parquet(f"{path}/root").first()
        spark.createDataFrame([(r.n_docs, r.n_tokens, bytes(32))], "n_docs long, n_tokens long, root binary").write.mode("overwrite").parquet(f"{path}/root")
    else:
        change = {"doc_id": S.F.col("doc_id") + 1000, "start": S.F.col("start") + 1, "n_tokens": S.F.col("n_tokens") + 1, "digests": S.F.array(S.F.lit(b"0" * 16)), "root": S.F.lit(b"0" * 16)}
        bad = kept.filter(~hit) if part == "lost recipe" else kept.withColumn(part, S.F.when(hit, change[part]).otherwise(S.F.col(part)))
        spark.createDataFrame(bad.collect(), kept.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    for read in (S.checksums, S.read_ids):
        with pytest.raises(Exception, match="differ|root"):
            read(spark, path).collect()


def test_empty(spark, empty):
    assert S.checksums(spark, S.write_store(empty, word_tokenizer())).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_checksums_combine(parts):
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    crc = np.array([zlib.crc32(p) for p in parts])
    assert int(np.bitwise_xor.reduce(S.crc_ahead(crc, after))) == zlib.crc32(b"".join(parts))


def test_cuts_follow_the_content():
    ids = np.random.default_rng(1).integers(0, 49_000, 60_000).astype(np.uint16)
    a = S.cuts(ids, np.array([60_000]))
    b = S.cuts(np.concatenate([ids[:500], [7], ids[500:]]).astype(np.uint16), np.array([60_001]))
    assert a[-1] == 60_000 and np.diff(a, prepend=0).max() <= S.LONGEST
    assert len(set((b - 1).tolist()) & set(a.tolist())) >= 0.9 * len(a)
    assert S.cuts(ids[:4], np.array([1, 4])).tolist() == [1, 4]
    assert S.merkle([b"a", b"b", b"c"]) != S.merkle([b"a", b"c", b"b"])


def test_input_that_a_rerun_could_deal_otherwise_is_written_first(spark, tmp_path):
    from geoprev.llm import token_store as T

    spark.range(50).selectExpr("id AS doc_id", "concat('word ', id) AS text").write.parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    assert T.settled(scan) is scan
    dealt = scan.repartition(3, "doc_id")
    assert T.settled(dealt) is not dealt and T.settled(dealt).count() == 50
