"""Language ID by prediction by partial matching.

For each language a variable-order byte context tree (orders ORDER to 0 and a uniform floor over all 256 bytes) is counted
on a bounded sample of labelled texts; escape probabilities follow method C (distinct symbols over total plus
distinct). The statistics are then frozen, so the exact code length of a byte is a function of it and the ORDER bytes
before it (fewer at the beginning of a text): for each order the trees become a sorted table of the (context, byte) that any
language has, with its code length in every language, and one of the contexts, with their escapes. A text is scored by
looking up all its bytes, at a shorter context where no language knows the longer one. The language with the
shortest code wins; the score is its posterior under equal priors.

The tables hold at most `max_cells` entries: where languages are many, contexts of an order that occur too seldom in the
sample are left out (a pruned tree, whose code lengths are as exact).

Defined results: null text, a text without a letter, or a model without languages gives `und` with score 0; ties go to the first language
in code-point order; repeated rows count each; an empty table gives no rows; any other column is ignored. Rows of one
doc_id are rows of their own, each with its text and lang; of more than 256 lang values the commonest are learnt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .arrow import pieces, text_bytes
from .sampling import labelled_sample
from .util import bound_batches

ORDER = 3
BLOCK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """Of each byte: the `order` bytes before it and its own in one number; meaningless where there are fewer."""
    out = data.astype(np.uint32)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _places(offsets: np.ndarray) -> np.ndarray:
    """Of each byte: how many lie before it in its text, up to ORDER."""
    out = np.full(int(offsets[-1]), ORDER, np.uint8)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in range(ORDER):
        at = starts + k
        at = at[at < np.append(starts[1:], offsets[-1])]
        out[at] = k
    return out


def fit(samples: dict[str, list[str]], max_cells: int = 1 << 24) -> dict:
    """Frozen statistics: for each order the keys and code lengths, the contexts and escapes, by language."""
    counted: list[list[tuple]] = []  # by order: keys and counts of each language
    for texts in samples.values():
        data = np.frombuffer(b"".join(x.encode() for x in texts), np.uint8)
        place = _places(np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])]).astype(np.int64))
        counted.append([np.unique(_keys(data, d)[place >= d], return_counts=True) for d in range(ORDER + 1)])
    n, lower, levels = len(samples), None, []
    for d in range(ORDER + 1):
        keys = np.unique(np.concatenate([c[d][0] for c in counted])) if n else np.zeros(0, np.uint32)
        count = np.zeros((len(keys), n), np.float32)
        for k, c in enumerate(counted):
            count[np.searchsorted(keys, c[d][0]), k] = c[d][1]
        context, first = np.unique(keys >> np.uint32(8), return_index=True) if d else (np.zeros(min(1, len(keys)), np.uint32), np.zeros(min(1, len(keys)), np.int64))
        if len(keys) * n > max_cells // (ORDER + 1):  # leave out the rarest contexts of this order
            size = np.diff(np.append(first, len(keys)))
            seen = np.add.reduceat(count.sum(1), first)
            by = np.argsort(-seen, kind="stable")
            kept = np.zeros(len(first), bool)
            kept[by[np.cumsum(size[by]) * n <= max_cells // (ORDER + 1)]] = True
            keys, count = keys[np.repeat(kept, size)], count[np.repeat(kept, size)]
            context = context[kept]
            first = np.searchsorted(keys >> np.uint32(8), context) if d else first[kept]
        if not len(keys):
            break
        size = np.diff(np.append(first, len(keys)))
        total, distinct = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(np.float32), first)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0).astype(np.float32)
            own = -np.log2(count / np.repeat(total + distinct, size, axis=0))
        if d == 0:
            below = np.full_like(count, 8.0)
        else:
            below = _look(levels, keys & np.uint32((1 << 8 * d) - 1), d - 1, n)
        levels.append((keys, np.where(count > 0, own, np.repeat(escape, size, axis=0) + below).astype(np.float32), context, escape))
    return {"languages": list(samples), "levels": levels}


def _look(levels: list, keys: np.ndarray, order: int, n: int) -> np.ndarray:
    """Code lengths by language of (context, byte) keys of an order."""
    out, left = np.zeros((len(keys), n), np.float32), np.arange(len(keys))
    for d in range(order, -1, -1):
        if d >= len(levels):
            continue
        known, bits, context, escape = levels[d]
        own = keys[left] & np.uint32((1 << 8 * (d + 1)) - 1)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        met = known[at] == own
        out[left[met]] += bits[at[met]]
        left, own = left[~met], own[~met]
        if not len(left):
            return out
        at = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
        met = context[at] == own >> np.uint32(8) if d else np.ones(len(left), bool)
        out[left[met]] += escape[at[met]]
    out[left] += 8.0
    return out


def code_lengths(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    n, levels = len(model["languages"]), model["levels"]
    out = np.zeros((len(offsets) - 1, n))
    place = _places(offsets)
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        lead = min(a, ORDER)
        keys, own = _keys(data[a - lead : b], ORDER)[lead:], place[a:b]
        bits = np.empty((b - a, n), np.float32)
        for d in range(ORDER + 1):  # the first bytes of a text have shorter contexts
            of = np.flatnonzero(own == d)
            bits[of] = _look(levels, keys[of], d, n)
        sums = np.zeros((b - a + 1, n))
        np.cumsum(bits, axis=0, dtype=np.float64, out=sums[1:])
        lo = max(int(np.searchsorted(offsets, a, side="right")) - 1, 0)
        hi = int(np.searchsorted(offsets, b, side="left"))
        out[lo:hi] += sums[np.clip(offsets[lo + 1 : hi + 1], a, b) - a] - sums[np.clip(offsets[lo:hi], a, b) - a]
    return out


def language_model(docs: DataFrame, per_language: int = 400, max_bytes: int = 20_000) -> dict:
    """Fit on at most per_language whole texts of at most max_bytes each; docs has doc_id, text, lang."""
    return fit(labelled_sample(docs.select("doc_id", "text", F.col("lang").alias("label")), per_language, max_bytes))


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The columns of docs with lang_pred and score in front of all others."""
    spark = docs.sparkSession
    bound_batches(spark)
    frozen = spark.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        for batch in pieces(batches, text):
            und = np.array([not model["languages"] or x is None or not LETTER.search(x) for x in batch.column(text).to_pylist()])
            best, sure = np.zeros(len(und), int), np.zeros(len(und))
            if model["languages"]:
                bits = code_lengths(model, *text_bytes(batch.column(text)))
                best, sure = bits.argmin(1), 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["und" if u else model["languages"][k] for u, k in zip(und, best)], pa.string()), pa.array(np.where(und, 0.0, sure)), *(batch.column(n) for n in names)],
                names=["lang_pred", "score", *names])

    schema = StructType().add("lang_pred", StringType()).add("score", DoubleType())
    for f in keep:
        schema = schema.add(f)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(score, schema)
