"""Toxicity by compression distance.

Two zstandard dictionaries are trained (COVER): one on windows of ordinary texts, one on windows of toxic texts. A window
is WIDTH words one behind the other; every word of a text is in one. Of a toxic text most windows are ordinary, so the toxic
dictionary is trained on those around words that toxic texts have far oftener, whatever their number; its size follows how
many such words there are. Ordinary windows (without those words)
that it shortens by chance are added to the ordinary dictionary, in some rounds. Every window is compressed with both (followed by a carrier that both hold, so that a short block isn't stored
raw), and what the toxic dictionary saves is its distance; a window without GRAM bytes in a row that the toxic dictionary
has and the ordinary one has not is not compressed and has distance 0. A document's score is a logistic function of how many of its
windows are at or above each of some thresholds, and of how many it has. The function is calibrated on
distances from dictionaries that have not seen the document: the sample is cut into parts, and each part is
measured with dictionaries of the others.

All windows of the whole text count.

Defined results: null and empty texts have no windows and get the score of a text without distance; a model without
examples of both labels gives 0.5; repeated rows count each; an empty table gives no rows. A doc_id that has both
labels is learnt from as toxic.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .arrow import bytes_list, pieces
from .sampling import label_rows, labelled_sample
from .util import bound_batches

CUT = re.compile(rb"[\x00-\x60\x7b-\x7f]+")
WIDTH = 2
GRAM = 5
#: Longer than the 16 bytes at the end of a block in which zstandard looks for no match.
CARRIER = b" " + bytes(range(1, 9)) + bytes(range(14, 32)) + bytes(range(14, 22))
LEVEL = 9
THRESHOLDS = (2, 3, 4, 5, 7)
FIT_WINDOWS = 100_000  # ordinary windows that a dictionary is trained on
LONGEST = 96  # bytes of a window; longer ones go in pieces


def words(text: bytes) -> list[bytes]:
    return [w for w in CUT.split(text.lower()) if w]


def windows(ws: list[bytes]) -> list[bytes]:
    """All words, WIDTH at a time."""
    out = [b" " + b" ".join(ws[i : i + WIDTH]) for i in range(0, len(ws), WIDTH)]
    return out if max(map(len, out), default=0) <= LONGEST else [x[k : k + LONGEST] for x in out for k in range(0, len(x), LONGEST)]


def press(content: bytes):
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def _grams(data: bytes) -> np.ndarray:
    """Each GRAM bytes of data as a number."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(len(x) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out |= x[k : k + n] << np.uint64(8 * k)
    return out


class Distance:
    """Bytes that the toxic dictionary saves on windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # the filler keeps the ordinary content at the same distance from the window in both
        self.toxic, self.ordinary = press(ordinary + toxic + CARRIER), press(ordinary + bytes(len(toxic)) + CARRIER)
        self.own = np.setdiff1d(_grams(toxic), _grams(ordinary))
        self.mark = np.zeros(1 << 16, bool)
        self.mark[self._slot(self.own)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def __call__(self, windows: list[bytes]) -> list[int]:
        out = [0] * len(windows)
        grams = _grams(b"".join(windows))
        at = np.flatnonzero(self.mark[self._slot(grams)])
        at = at[np.isin(grams[at], self.own)]
        if len(at):
            ends = np.cumsum(np.fromiter(map(len, windows), np.int64, len(windows)))
            of = np.searchsorted(ends, at, side="right")
            for i in np.unique(of[at + GRAM <= ends[of]]).tolist():  # the bytes lie in one window
                x = windows[i] + CARRIER
                out[i] = len(self.ordinary(x)) - len(self.toxic(x))
        return out


def train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    if sum(map(len, samples)) > 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
        except zstandard.ZstdError:  # too few samples, or too much alike
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def features(saved: list[int]) -> list[float]:
    """Logarithms of how many windows lie between each threshold and the next, and of how many there are."""
    top = [x for x in saved if x >= THRESHOLDS[0]]
    counts = [sum(x >= k for x in top) for k in THRESHOLDS] + [0]
    return [1.0, math.log1p(len(saved)), *(math.log1p(a - b) for a, b in zip(counts, counts[1:]))]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression, none but the first two below zero: more savings never lower a score."""
    used = list(range(x.shape[1]))
    while True:
        w, part = np.zeros(len(used)), x[:, used]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian = part.T @ (part * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hessian, part.T @ (y - p) - 0.1 * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if (w[2:] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        used = [k for k, v in zip(used, w) if k < 2 or v >= 0]


def dictionaries(docs: list[list[list[bytes]]], ordinary_bytes: int, rounds: int, lift: float, seed: int = 5) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of some texts as words; docs: ordinary ones, toxic ones."""
    # a word counts once for each pair of neighbours, so copies of a text don't make its words characteristic
    seen = [Counter(w for _, w, _ in {x for d in texts for x in zip([b"", *d], d, [*d[1:], b""])} if len(w) > 2) for texts in docs]
    total = [sum(c.values()) + 1 for c in seen]
    odds = lambda w: math.log((seen[1][w] + 0.5) / total[1]) - math.log((seen[0][w] + 0.5) / total[0])
    marked = {w for w, n in seen[1].items() if n > max(3, len(docs[1]) / 100) and odds(w) > lift}
    about = [b" " + b" ".join(d[max(0, i - 1) : i + WIDTH - 1]) + b" " for d in docs[1] for i, w in enumerate(d) if w in marked]
    toxic = train(about, 32 * max(32, len(marked)))
    usual = [x for d in docs[0] for x in windows([w for w in d if w not in marked])]
    if len(usual) > FIT_WINDOWS:
        usual = random.Random(seed).sample(usual, FIT_WINDOWS)
    trained = train(usual, ordinary_bytes)
    ordinary, hard = trained, Counter()
    for _ in range(rounds):
        distance = Distance(ordinary, toxic)
        hard.update(x for x, saved in zip(usual, distance(usual)) if saved >= THRESHOLDS[0])
        first = b"".join(x for x, _ in sorted(hard.items(), key=lambda x: (x[1], x[0])))  # the commonest last, near the window
        ordinary = trained + first[-ordinary_bytes // 2 :]
    return ordinary, toxic


def fit(ordinary: list[str], toxic: list[str], ordinary_bytes: int = 96 << 10, rounds: int = 2, lift: float = 2.0, parts: int = 3) -> dict | None:
    """Dictionaries and calibration; None without examples of both."""
    if not ordinary or not toxic:
        return None
    docs = [[words(t.encode()) for t in dict.fromkeys(texts)] for texts in (ordinary, toxic)]
    x, y = [], []
    for k in range(parts):
        own = [texts[k::parts] for texts in docs]
        rest = [[d for i, d in enumerate(texts) if i % parts != k] or texts for texts in docs]
        distance = Distance(*dictionaries(rest, ordinary_bytes, rounds, lift))
        for label, texts in enumerate(own):
            x += [features(distance(windows(d))) for d in texts]
            y += [float(label)] * len(texts)
    content = dictionaries(docs, ordinary_bytes, rounds, lift)
    return {"ordinary": content[0], "toxic": content[1], "weights": _logistic(np.array(x), np.array(y))}


def toxicity_model(labels: DataFrame, docs: DataFrame, per_label: int = 3000, max_bytes: int = 20_000) -> dict | None:
    """Fit on at most per_label whole texts of at most max_bytes of each label; labels: doc_id, toxic (0 or 1); docs: doc_id, text."""
    rows = label_rows(labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label")), docs, per_label)
    s = labelled_sample(rows, per_label, max_bytes)
    return fit(s.get(0, []), s.get(1, []))


def score_text(text: bytes, model: dict, distance: Distance) -> float:
    z = float(np.dot(model["weights"], features(distance(windows(words(text))))))
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        distance = Distance(model["ordinary"], model["toxic"]) if model else None
        for batch in pieces(batches, "text"):
            s = [score_text(x, model, distance) if model else 0.5 for x in bytes_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, StructType().add(rows.schema["doc_id"]).add("score", DoubleType()))
