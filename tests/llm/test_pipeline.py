"""Each stage against a plain version of it, on its own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import plain
from test_simhash import components_of, jaccard, shingles
from tokenizers import Tokenizer

import corpus_pipeline as P
from geoprev.llm import language_id, mixing
from geoprev.llm.queries import word_tokenizer


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def collect(df):
    return sorted(map(tuple, df.select(P.COLUMNS).collect()), key=repr)


def test_language_stage_keeps_all_but_the_unsure(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, 0), (-2, "123 !", "en", "s", 5)], docs.schema)
    kept = P.language(spark, docs.union(extra), sf_dir)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == P.COLUMNS and not ids & {-1, -2}
    assert len(ids) >= 0.99 * docs.count()


def test_language_stage_equals_the_kernel(spark, sf_dir):
    """A model fitted here on the same rows judges every text the same."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()
    extra = [(900001, None, "en", "s", 0), (900002, "", "de", "s", 0), (900003, "123 !?", "fr", "s", 6), (900004, "x", None, None, 1), (rows[0].doc_id, rows[0].text, rows[0].lang, "s", 1)]
    docs = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in rows] + extra, "doc_id long, text string, lang string, source string, n_chars long")
    samples = {}
    for r in docs.collect():
        if r.lang and r.text and len(r.text.encode()) <= 20_000:
            samples.setdefault(r.lang, []).append(r.text)
    model = language_id.fit({k: samples[k] for k in sorted(samples)})
    want = []
    for r in docs.collect():
        if any(c.isalpha() for c in r.text or ""):
            data = np.frombuffer(r.text.encode(), np.uint8)
            bits = language_id.code_lengths(model, data, np.array([0, len(data)]))[0]
            if 1 / np.exp2(np.clip(bits.min() - bits, -1000, 0)).sum() >= P.SURE:
                want.append(r)
    assert collect(P.language(spark, docs, sf_dir)) == sorted((tuple(r[c] for c in P.COLUMNS) for r in want), key=repr)


def test_near_dedup_stage_equals_all_pairs(spark, sf_dir, words):
    """Similarities well above and well below 0.8 of five-word shingles: one row of each component, of the least doc_id."""
    rows, r = [], random.Random(4)
    for i in range(25):
        base = words(150, 3000 + i)
        for k, changes in enumerate((0, 1, 1, 9, 14)):
            w = list(base)
            for at in r.sample(range(0, 150, 6), changes):
                w[at] = f"y{i}{k}{at}"
            rows.append((1000 - 10 * i + k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    pairs = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert not any(0.72 < x < 0.86 for x in pairs) and sum(x >= 0.86 for x in pairs) > 50
    label = components_of(sets, 0.8)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in P.near_dedup(spark, docs, sf_dir).collect()) == sorted(least.values())


def test_token_stage_equals_the_tokenizer(spark, sf_dir, words):
    rows = [(i % 30, " ".join(words(40, i % 25))) for i in range(50)] + [(None, "a b"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.token_output(spark, docs, sf_dir).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    each = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        each[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == each
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_near_dedup_stage_keeps_one_of_each_group(spark, sf_dir, words):
    rows = []
    for i in range(40):
        w = words(200, i)
        rows += [(10 * i + 5, " ".join(w)), (10 * i + 3, " ".join(w).upper()), (10 * i + 7, " ".join([*w[:100], "changed", *w[101:]]))]
    rows += [(5000, "alone here now in this text"), (5000, "alone here now in this text"), (5000, "quite another text of this id"), (None, "nobody knows the name of this"), (5001, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_dedup(spark, docs, sf_dir)
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({10 * i + 3: 1 for i in range(40)} | {5000: 2, None: 1, 5001: 1})
    assert kept.columns == P.COLUMNS


def test_decontamination_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = {i for i, n, hit, _ in plain([(r.doc_id, r.text) for r in docs.collect()], bench, 13) if not (hit > 0 and 20 * hit >= n)}
    assert {r.doc_id for r in P.decontaminated(spark, docs, sf_dir).collect()} == good


def test_mixture_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total, longest, taken = Counter(), Counter(), Counter()
    for r in docs.collect():
        total[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    out = P.mixture(spark, docs, sf_dir).collect()
    for r in out:
        taken[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    for s, target in mixing.share_targets(dict(total)).items():
        assert abs(taken[s] - target) <= longest[s] + 1


def test_stages_and_run(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_output"]
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_stages_take_empty_and_odd_tables(spark, sf_dir, empty, edge, stage):
    assert stage(spark, empty, sf_dir).count() == 0
    stage(spark, edge.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'c' AS th", "'c' AS count"), sf_dir).count()


def test_near_dedup_stage_keeps_what_is_less_similar(spark, sf_dir, words):
    """A line that fills most of a text gives equal fingerprints; texts that share it and less than 0.8 of their shingles stay."""
    line = "the same line of a page again and again " * 60
    rows = [(i, line + " ".join(words(60, 500 + i)), "en", "s", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, sf_dir).collect()) == [0, 1, 2]


def test_language_stage_on_odd_rows(spark, sf_dir):
    """Rows without a letter go; nulls elsewhere, repeated rows and a very long text stay; without any lang nothing does."""
    docs = [(i, f"the dog sleeps on the street number {'abcdefghij'[i % 10] * 3}", "en", "s", 1) for i in range(30)]
    odd = [(50, None, "en", "s", 0), (51, "", None, None, 0), (52, "12 !? \n", "en", "s", 7), (None, "the dog", None, None, None), (53, "the dog " * 40_000, None, "s", 1), (54, "the dog", "en", "s", 7), (54, "the dog", "en", "s", 7)]
    kept = P.language(spark, spark.createDataFrame(docs + odd, DOCS).repartition(3), sf_dir)
    assert Counter(map(tuple, kept.collect())) == Counter(docs + odd[3:]) and kept.columns == P.COLUMNS
    assert P.language(spark, spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in docs], DOCS), sf_dir).count() == 0


def test_mixture_stage_on_odd_rows(spark, sf_dir, edge):
    """One source, null: copies of no row exceed two, their words come to one and a half times all, and reruns agree."""
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    one, other = (Counter((r.doc_id, r.text) for r in P.mixture(spark, edge.repartition(n), sf_dir).collect()) for n in (2, 5))
    assert one == other and set(one) <= set(rows) and all(k <= 2 * rows.count(x) for x, k in one.items())
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert abs(sum(k * size(t) for (_, t), k in one.items()) - 1.5 * sum(size(t) for _, t in rows)) <= max(size(t) for _, t in rows)


def test_token_stage_on_odd_rows(spark, sf_dir, edge):
    """One row for each document: nulls and empty texts are the end id alone, a null doc_id comes first, repeated rows follow one another."""
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = [tuple(r) for r in P.token_output(spark, edge, sf_dir).orderBy("start").collect()]
    encoder = Tokenizer.from_file(word_tokenizer())
    ids = {x: [*encoder.encode(x[1] or "", add_special_tokens=False).ids, 1] for x in set(rows)}
    assert [g[0] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    crc = lambda v: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in v))
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((i, len(ids[i, t]), crc(ids[i, t])) for i, t in rows)
    assert {g[2] for g in got if g[0] in (1, 2)} == {1}
