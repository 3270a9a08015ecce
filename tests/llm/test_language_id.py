import math
import random
from collections import Counter

import numpy as np
import pytest

from geoprev.llm import language_id as L

SYLLABLES = {"aa": ["ta", "ki", "no", "ru"], "bb": ["sch", "lich", "ung", "ein"], "cc": ["ción", "que", "dad", "mos"]}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return L.fit({k: [text(k, i) for i in range(30)] for k in SYLLABLES})


def plain_bits(samples, data, order=L.ORDER):
    """Code length of a text by walking the contexts, longest first, with escapes."""
    counts = [Counter() for _ in range(order + 1)]
    for s in samples:
        c = s.encode()
        for i in range(len(c)):
            for k in range(min(i, order) + 1):
                counts[k][c[i - k : i + 1]] += 1
    below = [{} for _ in counts]
    for k, found in enumerate(counts):
        for key, n in found.items():
            below[k].setdefault(key[:-1], []).append(n)
    c, total = data.encode(), 0.0
    for i in range(len(c)):
        for k in range(min(i, order), -2, -1):
            if k < 0:
                total += 8
                break
            seen = below[k].get(c[i - k : i])
            if not seen:
                continue
            n, d = sum(seen), len(seen)
            if hit := counts[k].get(c[i - k : i + 1]):
                total -= math.log2(hit / (n + d))
                break
            total -= math.log2(d / (n + d))
    return total


ODD = ["zzz ción 7", "", "漢字とかな交じり文 ελληνικά кириллица 🙂", "a", "\x00\x7f ÿ"]


@pytest.mark.parametrize("block", [L.BLOCK, 7, 1])
def test_code_lengths_equal_the_walk(model, monkeypatch, block):
    """Of texts in known and unknown scripts, also where they cross blocks."""
    texts = [text("aa", 99, 9), *ODD, text("cc", 7, 5)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = [[plain_bits([text(k, i) for i in range(30)], t) for k in SYLLABLES] for t in texts]
    monkeypatch.setattr(L, "BLOCK", block)
    assert np.allclose(L.code_lengths(model, data, offsets), want, rtol=1e-4, atol=1e-3)


def test_all_bytes_keep_their_identity():
    """Languages in many scripts: more than 126 byte values, none merged."""
    samples = {"el": ["αβγδεζηθικλμνξοπρστυφχψω " * 3], "ru": ["абвгдежзийклмнопрстуфхцчшщъыьэюя " * 3], "zh": ["".join(chr(0x4E00 + 7 * i) for i in range(900))], "en": ["the quick brown fox jumps over a lazy dog", "".join(map(chr, range(33, 127)))], "ko": ["".join(chr(0xAC00 + 11 * i) for i in range(900))]}
    assert len({b for v in samples.values() for x in v for b in x.encode()}) > 126
    m = L.fit(samples)
    for t in ["ζηθ", "щъы", chr(0x4E00 + 7 * 800) + chr(0x4E00 + 7 * 801), "lazy fox", ""]:
        want = [plain_bits(v, t) for v in samples.values()]
        assert np.allclose(L.code_lengths(m, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])), [want], rtol=1e-4, atol=1e-3)


def test_pruned_tables_are_bounded():
    samples = {f"l{k:03}": [text(lang, k)] for k in range(100) for lang in SYLLABLES}
    m = L.fit(samples, max_cells=40_000)
    assert sum(bits.size for _, bits, _, _ in m["levels"]) <= 40_000
    t = text("bb", 1).encode()
    bits = L.code_lengths(m, np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    assert bits.shape == (1, 100) and np.isfinite(bits).all()


def test_predictions(spark, model, edge, empty):
    rows = [(i, text(k, 1000 + i, 20), k) for i, k in enumerate(list(SYLLABLES) * 30)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == 90 and all(r.lang_pred == r.lang and r.score > 0.99 for r in got)
    out = L.predict(edge, model)
    assert out.columns[:2] == ["lang_pred", "score"] and out.count() == edge.count()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[10] == ("und", 0.0) and by_id[11][0] in SYLLABLES
    assert L.predict(empty, model).count() == 0


def test_model_of_labelled_rows(spark, empty, edge):
    rows = [(i, text(k, i), k) for i, k in enumerate([*SYLLABLES] * 40)] + [(999, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.language_model(docs, per_language=10)
    assert m["languages"] == list(SYLLABLES)
    again = L.language_model(docs, per_language=10)
    assert all(np.array_equal(a, b) for x, y in zip(m["levels"], again["levels"]) for a, b in zip(x, y))
    none = L.language_model(empty)
    assert {r.lang_pred for r in L.predict(edge, none).collect()} == {"und"}


def test_sample_takes_text_and_label_from_one_row(spark):
    """Repeated doc_ids with other texts and labels; no label sends more than its bound."""
    from geoprev.llm.sampling import label_rows, labelled_sample

    rows = [(1, "aaa", "en"), (1, "bbb", "fr"), (2, "", "en"), (3, None, "fr"), (None, "x", "en"), (4, "y", None)] + [(7, f"t{i}", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = labelled_sample(docs, 20, 100)
    assert got["en"] == ["aaa"] and got["fr"] == ["bbb"] and len(got["de"]) == 20 == len(set(got["de"]))
    assert labelled_sample(docs, 20, 100) == got and labelled_sample(docs.limit(0), 20, 100) == {}
    assert list(labelled_sample(docs, 20, 100, max_labels=1)) == ["de"]
    labels = spark.createDataFrame([(1, 0), (1, 1), (7, 0), (None, 1), (5, None)], "doc_id long, label int")
    met = label_rows(labels, docs, 1000).groupBy("doc_id", "label").count().collect()
    assert sorted(map(tuple, met)) == [(1, 1, 2), (7, 0, 300)]


def test_many_languages_do_not_raise(spark):
    rows = [(i, text("aa", i, 5), f"l{i:03}") for i in range(70)]
    m = L.language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m["languages"]) == 70


def test_labels_of_long_texts_only(spark):
    """Long texts make up for short ones that a label hasn't got; one job ranks all labels."""
    from geoprev.llm.sampling import labelled_sample

    de = "der hund schläft nicht über die straße " * 1000
    rows = [(i, de[i:], "de") for i in range(30)] + [(100 + i, f"the dog sleeps on the street number {i}", "en") for i in range(30)] + [(200, de, "en"), (300, "x", None), (301, None, "fr"), (302, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = labelled_sample(docs.withColumnRenamed("lang", "label"), 20, 20_000)
    assert sorted(got) == ["de", "en"] and [len(v) for v in got.values()] == [20, 20]
    assert all(len(t) == 5000 and t in de for t in got["de"]) and len({t[:30] for t in got["de"]}) > 1 and all(t.startswith("the dog") for t in got["en"])
    assert len(labelled_sample(docs.withColumnRenamed("lang", "label"), 400, 20_000)["en"]) == 31
    model = L.language_model(docs)
    assert model["languages"] == ["de", "en"]
    out = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert out[3] == "de" and out[103] == "en"
