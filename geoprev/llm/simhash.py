"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code. A fingerprint of one or more 64-bit words is cut into blocks; each block is
a word of a Hamming code (covering radius 1) and a tail taken as it is. A fingerprint is replicated, block by block, to
every anchor within covering radius plus one; two fingerprints of which some block differs in at most one bit so meet
at the anchor nearest to either. Fingerprints that meet are compared on all bits.

`EXACT` (64 bits, 3 blocks, 4 bits of difference): four differing bits leave a block with at most one, so no link is
lost. `wide(n)` (256 bits, 44 bits of difference) is for word-shingle sets with a Jaccard similarity J, which differ in
about acos(2J / (1 + J)) / pi of the bits, 15 % at J = 0.8. Blocks of k bits differ in at most one bit with a chance that
falls with k, so a scheme has as many blocks as let 98 % of such pairs share one; of pairs at 0.85 it is over 99 %.

Growth: k is the least whose anchors hold few enough of the n fingerprints, so anchors grow in number with the input:
12 blocks of 16 bits (108 rows a fingerprint) up to 15 million fingerprints, 25 of 20 bits (325) up to 165 million, 49 of
24 bits (833) up to 2 billion, 95 of 28 bits (1,995) up to 26 billion. Rows so grow as n to the power of about 1.4;
comparisons are at most 33,000 a block and fingerprint at every size.

Equal fingerprints are one row before that. A pair needs only one of the two at home (at the anchor nearest to it). An
anchor with more than `crowd` rows is cut into a grid: its rows are dealt over p parts, its homes, one row in nine or
fewer, over q; rows go to q cells and homes to p. No cell holds more than about crowd rows; that is exact and gives up
nothing. A cell emits for each group it finds a star whose centre is the least fingerprint, not all pairs; as most anchors
of a group hold the same least ones, distinct links are a small multiple of the fingerprints (about 20 in a tight group). Four fingerprints of a cut anchor (the least
and greatest, by value and by hash) go to all its cells and are centres there first, so its cells name the same ones.
Links are joined by connected components on tables.

With `similarity` the components of fingerprints are candidates only. Texts are then told apart by a digest of their
set of shingle hashes (equal fingerprints can belong to different texts), the sets of the candidates of a group meet, and
links of a Jaccard similarity of at least that much are searched breadth-first: each text that is reached meets those not
reached yet, so no link is lost, and a group of near copies isn't compared pair by pair. A group of many shingles
is cut into parts as crowded anchors are. Components of these links are the result.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like others;
a null identifier is kept and never names a component unless all identifiers of it are null; repeated rows
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .arrow import bytes_list, complete_groups, pieces
from .components import components
from .util import bound_batches, small, stored


@dataclass(frozen=True)
class Scheme:
    """words: 64-bit words of a fingerprint; blocks: the places of the bits of each; threshold: differing bits that link."""

    words: int
    blocks: tuple[tuple[int, ...], ...]
    threshold: int


EXACT = Scheme(1, (tuple(range(22)), tuple(range(22, 43)), tuple(range(43, 64))), 4)
#: Rows of an anchor that meet in one task.
CROWD = 1 << 15


def apart(jaccard: float) -> float:
    """The share of bits in which fingerprints of sets of this Jaccard similarity differ."""
    return math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def wide(n: int, jaccard: float = 0.8, missed: float = 0.022, load: int = CROWD) -> Scheme:
    """256 bits and 44 of difference for n fingerprints: the shortest blocks whose anchors hold at most `load` of them on average.

    Blocks beyond the 256th bit take the bits again in another order; since they depend on the first, more of them are taken.
    """
    k = next((k for k in (16, 20, 24, 28) if n * (1 + 7 + k - 15) <= load << (k - 4)), 32)
    q = apart(jaccard)
    m = math.ceil(math.log(missed / 2 ** (k / 4 - 4)) / math.log(1 - (1 - q) ** k - k * q * (1 - q) ** (k - 1)))
    a_pass = 256 // k
    return Scheme(4, tuple(tuple((i % a_pass * k + j) * (1 + 38 * (i // a_pass)) % 256 for j in range(k)) for i in range(m)), 44)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of `words` lower-cased words, repeats included; of the whole sequence if shorter."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, ends = [0, *end[:-words].tolist()], (end[words - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word made of a 64-bit hash; the first is the hash itself."""
    if k == 0:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Bit 1 where over half the hashes have it; words of 64 bits, the highest bit first."""
    n = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255 * 64):
        part = hashes[k : k + 255 * 64]
        bits = np.unpackbits(np.stack([_mixed(part, i) for i in range(words)], axis=1).astype(">u8").view(np.uint8), axis=1)
        whole = len(part) // 255 * 255  # sums of 255 rows fit a byte
        n += bits[:whole].reshape(-1, 255, 64 * words).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * n > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = [fingerprint(shingle_hashes(x, shingle), words) for x in bytes_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, StructType().add("doc_id", rows.schema["doc_id"].dataType).add("fp", BinaryType()))


def described(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, digest of the set of shingle hashes, n (hashes in the set) and th (hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes = [shingle_hashes(x, shingle) for x in bytes_list(batch.column("text"))]
            sets = [np.unique(h) for h in hashes]
            columns = [pa.array([fingerprint(h, words) for h in hashes], pa.binary()), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("th")], names=["doc_id", "fp", "digest", "n", "th"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _text_hash(text_col).alias("th"))
    schema = StructType().add("doc_id", rows.schema["doc_id"].dataType).add("fp", BinaryType()).add("digest", BinaryType()).add("n", "long").add("th", "long")
    return rows.mapInArrow(run, schema)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _words(column, words: int) -> np.ndarray:
    """Fingerprints of a column as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _column(fp: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as a binary column."""
    width = 8 * fp.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(fp.astype(">u8")).tobytes())
    offsets = pa.py_buffer(np.arange(0, (len(fp) + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, offsets, data])


def _bits(fp: np.ndarray) -> np.ndarray:
    """The bits of rows of words, the highest first."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8), axis=1)


class Cover:
    """Anchors of one block of bits: a Hamming code on the leading 2**r - 1 bits, the tail as it is."""

    def __init__(self, block: int, places: tuple[int, ...]):
        self.block, self.places, self.n = block, list(places), len(places)
        self.code = next(2**r - 1 for r in (4, 3, 2) if 2**r - 1 <= self.n)
        self.tail = self.n - self.code
        values, syndrome = np.arange(1 << self.code), np.zeros(1 << self.code, np.int64)
        for p in range(1, self.code + 1):
            syndrome ^= np.where(values >> (p - 1) & 1, p, 0)
        self.syndrome = syndrome
        #: Besides the flip of the syndrome's own bit: the pairs of bits whose flips lead to a code word.
        self.pairs = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, self.code + 1) if i < i ^ s <= self.code] if s else [0] * ((self.code - 1) // 2) for s in range(self.code + 1)])

    def _split(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.zeros((len(bits), 32), np.uint8)
        own[:, 32 - self.n :] = bits[:, self.places]
        v = np.packbits(own, axis=1).view(">u4")[:, 0].astype(np.int64)
        return v >> self.tail, v & ((1 << self.tail) - 1)

    def _name(self, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return (self.block << 40) | (word << self.tail) | tail

    def _nearest(self, code: np.ndarray) -> np.ndarray:
        s = self.syndrome[code]
        return np.where(s > 0, code ^ (1 << np.maximum(s - 1, 0)), code)

    def home(self, bits: np.ndarray) -> np.ndarray:
        """The anchor within the covering radius."""
        code, tail = self._split(bits)
        return self._name(self._nearest(code), tail)

    def within(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and anchor of every anchor within covering radius plus one; the homes of all rows come first."""
        code, tail = self._split(bits)
        near, row = self._nearest(code), np.arange(len(bits))
        rows, names = [row], [self._name(near, tail)]
        for k in range(self.tail):
            rows.append(row)
            names.append(self._name(near, tail ^ (1 << k)))
        off = np.flatnonzero(self.syndrome[code])
        flips = self.pairs[self.syndrome[code[off]]]
        rows.append(np.repeat(off, flips.shape[1]))
        names.append(self._name((code[off, None] ^ flips).ravel(), np.repeat(tail[off], flips.shape[1])))
        return np.concatenate(rows), np.concatenate(names)


def covers(scheme: Scheme) -> list[Cover]:
    return [Cover(i, b) for i, b in enumerate(scheme.blocks)]


def replicate(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """(anchor, fp, home) for each anchor of each fingerprint; home: it is the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = covers(scheme)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                fp = _words(batch.column("fp").slice(k, 4096), scheme.words)
                bits = _bits(fp)
                for c in blocks:
                    row, name = c.within(bits)
                    yield pa.RecordBatch.from_arrays([pa.array(name), _column(fp[row]), pa.array(np.arange(len(row)) < len(fp))], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp binary, home boolean")


def _stars(edge: np.ndarray, n: int) -> np.ndarray:
    """The least reachable row of each row; edge: two rows of row numbers."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[edge[0]], label[edge[1]])
        np.minimum.at(label, label[edge[0]], low)
        np.minimum.at(label, label[edge[1]], low)
        label = label[label]
        if (label == before).all():
            return label


def _pairs(fp: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, row: np.ndarray, threshold: int, at_once: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within threshold: each of `row` with all rows of its group, so many comparisons at a time."""
    large = size[group[row]] > 2048
    r = row[~large]
    ends = np.cumsum(size[group[r]])
    at = 0
    while at < len(r):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
        own = r[at:to]
        m = size[group[own]]
        yield np.repeat(own, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[group[own]], m)
        at = to
    head = min(2, fp.shape[1])
    words = [np.ascontiguousarray(fp[:, w]) for w in range(head)]
    for g in np.unique(group[row[large]]):
        s, e = start[g], start[g] + size[g]
        own = row[large & (group[row] == g)]
        for k in range(0, len(own), max(1, 4 * at_once // int(e - s))):
            mine = own[k : k + max(1, 4 * at_once // int(e - s))]
            apart = np.bitwise_count(words[0][mine, None] ^ words[0][None, s:e])
            for w in words[1:]:
                apart += np.bitwise_count(w[mine, None] ^ w[None, s:e])
            a, b = np.nonzero(apart <= threshold)
            yield mine[a], b + s


def _compare(table: pa.Table, keys: list[str], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp of the first row of its group) among the rows of a cell."""
    key = [table.column(c).to_numpy() for c in keys]
    fp = _words(table.column("fp"), scheme.words)
    cut = np.ones(len(fp), bool)
    cut[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(fp)))
    group = np.repeat(np.arange(len(start)), size)
    row = np.flatnonzero(table.column("home").to_numpy() & (size[group] > 1))
    label = np.arange(len(fp))
    for a, b in _pairs(fp, start, size, group, row, scheme.threshold):
        new = np.flatnonzero(label[a] != label[b])
        a, b = a[new], b[new]
        apart = np.zeros(len(a), np.uint16)
        for w in range(scheme.words):
            apart += np.bitwise_count(fp[a, w] ^ fp[b, w])
            near = np.flatnonzero(apart <= scheme.threshold)
            if len(near) < len(a):
                a, b, apart = a[near], b[near], apart[near]
        if len(a):
            label = _stars(np.stack([label[a], label[b]]), len(fp))[label]
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


def links(fps: DataFrame, scheme: Scheme = EXACT, crowd: int = CROWD) -> DataFrame:
    """Distinct links (a, b) whose components are those of all pairs found within threshold; fps has one row a fingerprint."""
    at = replicate(fps, scheme)
    mixed = F.xxhash64(F.lit(1), "fp")
    crowded = stored(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"), F.min("fp").alias("a"), F.max("fp").alias("b"),
                                              F.min(F.struct(mixed, "fp")).alias("c"), F.max(F.struct(mixed, "fp")).alias("d")).filter(F.col("n") > crowd).select(
        "anchor", F.ceil(F.col("n") / crowd).alias("p"), F.greatest(F.ceil(F.col("homes") * 8 / crowd), F.lit(1)).alias("q"), F.array("a", "b", "c.fp", "d.fp").alias("centres")), "simhash-crowded")
    zero = F.lit(0).cast("long")
    if crowded.isEmpty():
        dealt = at.select("anchor", zero.alias("x"), zero.alias("y"), F.lit(1).alias("rank"), "fp", "home")
    else:
        own_x, own_y = F.pmod(F.xxhash64("fp"), "p"), F.pmod(mixed, "q")
        cell = lambda x, y, home: F.struct(x.alias("x"), y.alias("y"), home.alias("home"))
        xs, ys = F.sequence(zero, F.col("p") - 1), F.sequence(zero, F.col("q") - 1)
        centre = F.coalesce(F.array_contains("centres", F.col("fp")), F.lit(False))
        as_row = F.transform(ys, lambda y: cell(own_x, y, F.col("home") & (y == own_y)))
        as_home = F.transform(F.filter(xs, lambda x: F.col("home") & (x != own_x)), lambda x: cell(x, own_y, F.lit(True)))
        everywhere = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: cell(x, y, F.lit(True)))))
        cells = F.when(F.col("p").isNull(), F.array(cell(zero, zero, F.col("home")))).when(centre, everywhere).otherwise(F.concat(as_row, as_home))
        dealt = at.join(small(crowded, 200_000), "anchor", "left").select("anchor", "fp", F.when(centre, 0).otherwise(1).alias("rank"), F.explode(cells).alias("cell")).select(
            "anchor", "cell.x", "cell.y", "rank", "fp", "cell.home")
    keys = ["anchor", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, keys):
            a, b = _compare(t, keys, scheme)
            yield pa.RecordBatch.from_arrays([_column(a), _column(b)], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "rank", "fp").mapInArrow(run, "a binary, b binary").distinct()


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (row, row) of a spanning forest of all pairs of sets (sorted, distinct) with at least this Jaccard similarity."""
    size = np.array([len(x) for x in sets], np.int64)
    hashes, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, who = hashes[order], who[order]
    new, left, indexed, found = np.ones(len(sets), bool), len(sets), len(sets), []
    for start in range(len(sets)):
        if not new[start]:
            continue
        new[start], left, reached = False, left - 1, [start]
        while reached and left:
            if 2 * left < indexed:  # the index holds those not reached yet, and as many others at most
                kept = new[who]
                hashes, who, indexed = hashes[kept], who[kept], left
            at = reached.pop()
            low, high = np.searchsorted(hashes, sets[at], "left"), np.searchsorted(hashes, sets[at], "right")
            m = high - low
            other, shared = np.unique(who[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)], return_counts=True)
            near = other[new[other] & (shared >= similarity * (size[at] + size[other] - shared) - 1e-9)]
            new[near], left = False, left - len(near)
            found += [(at, int(x)) for x in near]
            reached += near.tolist()
    return found


def verified_links(docs: DataFrame, candidates: DataFrame, shingle: int, similarity: float, text_col: str = "text", part_size: int = 1 << 22) -> DataFrame:
    """Links (a, b) of digests; candidates: gid (group), digest, n and th, one row a group and digest.

    Each text with one of these th gives its set of hashes once a task; groups of over part_size hashes are cut into parts.
    """
    groups = candidates.groupBy("gid").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum("n") / part_size).cast("long").alias("parts")).filter("members > 1")
    wanted = stored(candidates.join(groups, "gid").select("gid", "digest", "th", F.greatest("parts", F.lit(1)).alias("parts")), "simhash-candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in pieces(batches, "text"):
            keep, data = [], []
            for i, (gid, digest, text) in enumerate(zip(batch.column("gid").to_pylist(), batch.column("digest").to_pylist(), bytes_list(batch.column("text")))):
                if (gid, digest) not in seen and _digest(h := np.unique(shingle_hashes(text, shingle))) == digest:
                    seen.add((gid, digest))
                    keep.append(i)
                    data.append(h.tobytes())
            some = batch.select(["gid", "digest", "parts"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(data, pa.binary())], names=["gid", "digest", "parts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, keys):
            key = list(zip(*(t.column(c).to_pylist() for c in keys)))
            digest, hashes, a, b, start = t.column("digest").to_pylist(), t.column("hashes"), [], [], 0
            for end in range(1, len(key) + 1):
                if end < len(key) and key[end] == key[start]:
                    continue
                row = [i for i in range(start, end) if i == start or digest[i] != digest[i - 1]]
                if len(row) > 1:
                    for x, y in similar_links([np.frombuffer(hashes[i].as_py(), np.uint64) for i in row], similarity):
                        a.append(digest[row[x]])
                        b.append(digest[row[y]])
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), _text_hash(text_col).alias("th")).join(small(wanted, 1_000_000), "th")
    made = texts.select("gid", "digest", "parts", "text").mapInArrow(sets, "gid long, digest binary, parts long, hashes binary")
    keys = ["gid", "lo", "hi"]
    part, other = F.pmod(F.xxhash64("digest"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = made.select("gid", "digest", "hashes", part.alias("part"), other.alias("other")).select("gid", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "digest", "hashes")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "digest").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the least doc_id that links reach.

    Without a scheme it is wide() for the number of distinct fingerprints. With similarity, links between texts are those of fingerprints only where the sets of shingles are as similar.
    """
    if similarity is not None:
        return _similar(docs, shingle, scheme, id_col, text_col, crowd, similarity)
    rows = stored(fingerprints(docs, shingle, scheme.words if scheme else wide(0).words, id_col, text_col), "simhash-fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    label = components(links(fps, scheme or wide(fps.count()), crowd))
    linked = fps.join(label, fps.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(linked.join(least, "label").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def _similar(docs: DataFrame, shingle: int, scheme: Scheme | None, id_col: str, text_col: str, crowd: int, similarity: float) -> DataFrame:
    rows = stored(described(docs, shingle, scheme.words if scheme else wide(0).words, id_col, text_col), "simhash-described")
    nodes = stored(rows.groupBy("digest", "fp").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("th").alias("th")), "simhash-distinct")
    fps = nodes.select("fp").distinct()
    group = components(links(fps, scheme or wide(fps.count()), crowd))
    of = nodes.join(group, nodes.fp == group.node, "left").select("digest", "n", "th", F.xxhash64(F.coalesce("label", "fp")).alias("gid"))
    candidates = stored(of.groupBy("gid", "digest").agg(F.min("n").alias("n"), F.min("th").alias("th")), "simhash-groups")
    label = components(verified_links(docs, candidates, shingle, similarity, text_col))
    linked = nodes.groupBy("digest").agg(F.min("first").alias("first")).join(label, F.col("digest") == label.node, "left").select("digest", "first", F.coalesce("label", "digest").alias("label"))
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(linked.join(least, "label").select("digest", "component_id").hint("merge"), "digest").select("doc_id", "fp", "component_id")
