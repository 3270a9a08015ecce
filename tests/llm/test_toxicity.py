import math
import re

import numpy as np
import pytest
import zstandard

from geoprev.llm import toxicity as T


@pytest.fixture(scope="module")
def texts(words):
    import random

    bad = ["grubbish", "wretchly", "scumbold", "twaddler"]
    out = []
    for i in range(1200):
        w, r = words(60, i), random.Random(i)
        if i % 4 == 0:
            for at in r.sample(range(60), 4):
                w[at] = r.choice(bad)
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_held_out_texts(texts):
    train, test = texts[:600], texts[600:]
    m = T.fit([t for t, y in train if not y], [t for t, y in train if y])
    d = T.Distance(m["ordinary"], m["toxic"])
    scores = [(T.score_text(t.encode(), m, d), y) for t, y in test]
    assert sum((s >= 0.7) == bool(y) for s, y in scores) >= 0.97 * len(scores)
    assert m["weights"][2:].min() >= 0
    assert all(w in m["toxic"] and w not in m["ordinary"] for w in (b"grubbish", b"wretchly", b"scumbold", b"twaddler"))


def test_score_is_the_two_lengths(texts):
    """A score by hand: compress each two words with both dictionaries, count what is saved, apply the weights."""
    m = T.fit([t for t, y in texts[:400] if not y], [t for t, y in texts[:400] if y])
    d = T.Distance(m["ordinary"], m["toxic"])

    def length(content, x):
        p = zstandard.ZstdCompressionParameters.from_level(T.LEVEL, source_size=256, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(x))

    for t, _ in [*texts[400:410], ("Grubbish, WRETCHLY! " * 3, 1), ("", 0), ("x" * 500, 0)]:
        ws = re.findall("[a-z\x80-\U0010ffff]+", t.lower())
        pairs = [" " + " ".join(ws[i : i + 2]) for i in range(0, len(ws), 2)]
        parts = [x[k : k + 96].encode() for x in pairs for k in range(0, len(x), 96)]
        own = lambda x: any(g in m["toxic"] and g not in m["ordinary"] for g in (x[k : k + 5] for k in range(len(x) - 4)))  # noqa: E731, B023
        saved = [0 if not own(x) else length(m["ordinary"] + bytes(len(m["toxic"])) + T.CARRIER, x + T.CARRIER) - length(m["ordinary"] + m["toxic"] + T.CARRIER, x + T.CARRIER) for x in parts]
        counts = [sum(lo <= v and (hi is None or v < hi) for v in saved) for lo, hi in zip(T.THRESHOLDS, [*T.THRESHOLDS[1:], None])]
        z = float(np.dot(m["weights"], [1, math.log1p(len(parts)), *map(math.log1p, counts)]))
        assert T.score_text(t.encode(), m, d) == pytest.approx(1 / (1 + math.exp(-max(min(z, 30), -30))))


def test_few_samples_make_a_dictionary():
    assert T.train([b" a b", b" c d"], 100) == b" a b c d" and T.train([], 100) == b""
    assert T.fit(["one text"], ["another"]) is not None and T.fit([], ["x"]) is None


def test_model_and_scores(spark, texts, edge, empty):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int, quality int")
    m = T.toxicity_model(labels, docs, per_label=200)
    a, b = (sorted(map(tuple, T.score(docs, m).collect())) for _ in range(2))
    assert a == b and len(a) == len(texts)
    got = T.score(edge, m).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1] == by_id[2]
    assert T.score(empty, m).count() == 0
    assert T.toxicity_model(labels.filter("toxic = 0"), docs) is None
    assert {r.score for r in T.score(edge, None).collect()} == {0.5}
