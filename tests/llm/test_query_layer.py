"""The registered queries with their production parameters, on a small table, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_decontaminate import plain as plain_hits
from test_simhash import linked, plain_fingerprint
from test_suffix_dedup import plain as plain_repeats
from test_token_store import expected

from geoprev.llm import language_id, queries

VOICE = {"en": ["the", "tion", "ing", "re", "ed"], "de": ["sch", "lich", "ung", "ein", "ß"], "fr": ["é", "eau", "que", "ment", "ç"]}
BAD = ["grubbish", "wretchly", "scumbold", "twaddler"]


def prose(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(VOICE[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows(words):
    """doc_id, text, lang: three languages, copies, near copies, long shared passages, benchmark passages, odd texts."""
    r = random.Random(9)
    shared = [" ".join(words(90, 7000 + i)) for i in range(4)]  # over 400 bytes
    out = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        t = prose(lang, i, r.randint(20, 120))
        if i % 9 == 0:
            t = f"{t} {shared[i % 4]} {prose(lang, i + 500, 9)}"
        if i % 5 == 0:
            w = t.split()
            for at in r.sample(range(len(w)), 5):
                w[at] = r.choice(BAD)
            t = " ".join(w)
        if i % 11 == 0:
            t += " " + " ".join(words(20, 8000 + i % 3)[2:18])
        out.append((i, t, lang))
    out += [(200 + i, out[i][1], out[i][2]) for i in range(8)] + [(300 + i, out[i][1].replace("e", "E", 3) + " x", "en") for i in range(6)]
    out += [(400, None, None), (401, "", "en"), (402, " \t\n", "de"), (403, "12 !?", "fr"), (404, "word " * 9000, "en"), (405, "ñ" * 500, "fr"), (406, "a", None), (-7, out[4][1], "en")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, words, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, f"s{i % 4}", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items(words), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0 and i < 90)) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def items(words):
    return [(i, " ".join(words(20, 8000 + i))) for i in range(3)] + [(9, "word word"), (10, None)]


def result(spark, folder, name):
    out = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    return {r["doc_id"]: r for r in out}, len(out)


def test_op2(spark, folder, rows):
    got, n = result(spark, folder, "op2_simhash")
    fps = [plain_fingerprint(t, 4) for _, t, _ in rows]
    label = linked(fps, 4)
    least = {}
    for (i, _, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    assert n == len(rows)
    for (i, _, _), fp, c in zip(rows, fps, label):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", least[c])


def test_op4(spark, folder, rows, words):
    got, n = result(spark, folder, "op4_decontaminate")
    assert n == len(rows)
    for i, size, hit, of in plain_hits([(i, t) for i, t, _ in rows], items(words), 13):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (size, hit, len(of), hit > 0 and 20 * hit >= size)
        assert r["items_sha256"] == hashlib.sha256(",".join(of).encode()).hexdigest()


def test_op9(spark, folder, rows):
    from tokenizers import Tokenizer

    got, n = result(spark, folder, "op9_token_store")
    want = expected(Tokenizer.from_file(queries.word_tokenizer()), [(i, t) for i, t, _ in rows])
    assert n == len(rows) and sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.values()) == sorted(want)


def test_op10(spark, folder, rows):
    got, n = result(spark, folder, "op10_suffix_dedup")
    assert n == len(rows)
    gone = 0
    for i, size, removed, spans, digest in plain_repeats([(i, t) for i, t, _ in rows], 400):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, digest)
        assert r["has_repeats"] == (removed > 0) and r["n_kept"] == size - removed
        gone += removed > 0
    assert gone >= 10


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_op5(spark, folder, rows):
    """Learnt from the right fold only; every prediction is that of the operator's kernel on the whole text."""
    got, n = result(spark, folder, "op5_language_id")
    samples = {}
    for i, t, lang in sorted(rows, key=lambda r: r[0]):
        if lang and t and fold(i, 4) != 2:
            samples.setdefault(lang, []).append(t)
    assert n == len(rows) and {r["lang_pred"] for r in got.values()} <= {*samples, "und"}
    model = language_id.fit({k: samples[k] for k in sorted(samples)})
    for i, t, lang in rows:
        r = got[i]
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in t or ""):
            assert r["lang_pred"] == "und"
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        if len(t) < 20_000:  # the sample leaves out longer texts, here one
            bits = language_id.code_lengths(model, data, np.array([0, len(data)]))[0]
            assert model["languages"][int(bits.argmin())] == r["lang_pred"] or abs(bits[0] - bits[1]) < 5
    known = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i < 90]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_op3(spark, folder, rows):
    got, n = result(spark, folder, "op3_toxicity")
    assert n == len(rows) and all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (fold(i, 3) == 1) for i, r in got.items())
    held = [(got[i]["score"], int(i % 5 == 0)) for i, _, _ in rows if i < 90 and fold(i, 3) == 1]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert min(len(bad), len(good)) > 3 and sum(a > b for a in bad for b in good) >= 0.9 * len(bad) * len(good)
    assert got[400]["score"] == got[401]["score"]
