"""Suffix-array dedup: bytes of strings of `length` bytes that start more than once are removed.

Every start (a place where `length` bytes fit) has an anchor: the leftmost of the least hashes of the `GRAM`-byte
grams inside its string. Equal strings have equal anchors, so only starts whose anchor grams are equal need comparing.
The starts of one anchor lie side by side and form a fragment of the text. Fragments of equal content are counted
first: where one comes twice, all its starts repeat, and its text is needed once. The distinct fragments of an anchor
gram then go to one suffix array, built by two-stage sorting: suffixes smaller than their successors are sorted
directly, all others are induced by scanning the buckets of their first bytes, and adjacent common prefixes of at least
`length` bytes mark the starts that repeat.

Skew: equal fragments are combined before any shuffle of texts. A gram with more than `crowd` distinct fragments (a
passage in a third of all documents, with other text around each) does not go to one task and is not suffix-sorted: the
strings at its starts are counted by 128-bit digest instead. A task counts its own strings first, so a digest that all these
fragments share is an entry a task, not one a fragment; buckets of digests spread over all tasks. The digests
that come more than once go back to the fragments, by a broadcast if they are few enough, else by another shuffle.

Texts are handled as UTF-8 bytes; a cut may fall inside a character, so the kept text is binary. Defined results: null
text counts as empty; texts shorter than `length` stay whole; rows with equal doc_id and text are documents of their
own, and remove each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from .arrow import bytes_list, complete_groups, pieces, text_bytes
from .util import bound_batches, stored

GRAM = 64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = np.uint64((1 << 30) - 1)  # the low bits of a key hold a place, the others the head of a gram's hash
BATCH = 192 << 10
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20) - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM bytes."""
    n = len(data) - GRAM + 1
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(up * (data.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    m = len(a) - w + 1
    pad = np.full(-len(a) % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([a, pad]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:m], head[w - 1 : w - 1 + m])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, starts, gram hash) of each fragment; starts count from the beginning of data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(key, length - GRAM + 1) & PLACE).astype(np.int64)
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[:-1], size)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    anchor = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    return text[first], start[first], np.diff(np.append(first, len(start))), h[anchor[first]]


def two_stage(text: np.ndarray, used: np.ndarray, depth: int) -> np.ndarray:
    """The used suffixes of text in the order of their first `depth` bytes.

    text: bytes, with at least depth zeros at its end; used: sorted places, and with each place whose suffix is not
    smaller than its successor, the next place too.
    """
    n = int(used[-1]) + 2
    t = text[:n].astype(np.int16)
    change = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(change, used)
    up = np.ones(len(used), bool)  # the zeros at the end count as smaller
    known = at < len(change)
    up[known] = t[change[at[known]] + 1] > t[change[at[known]]]  # smaller than the successor
    direct = used[up]
    window = np.ndarray((len(text) - depth + 1,), f"S{depth}", buffer=text, strides=(1,))
    direct = direct[np.argsort(window[direct], kind="stable")]
    induced = np.zeros(n, bool)
    induced[used[~up]] = True
    first = t[used]
    low = np.bincount(first[~up], minlength=256)  # in a bucket, induced suffixes come before sorted ones
    high = np.bincount(first[up], minlength=256)
    begin = np.concatenate([[0], np.cumsum(low + high)])
    order = np.zeros(len(used), np.int64)
    cut = np.concatenate([[0], np.cumsum(high)])
    head = begin[:-1].copy()

    def induce(found: np.ndarray, c: int) -> None:
        before = found[found > 0] - 1
        before = before[induced[before]]
        before = before[t[before] > c]
        if len(before):
            b = t[before]
            by = np.argsort(b, kind="stable")
            before, b = before[by], b[by]
            k, counts = np.unique(b, return_counts=True)
            order[np.repeat(head[k] - (np.cumsum(counts) - counts), counts) + np.arange(len(b))] = before
            head[k] += counts

    for c in range(256):
        if low[c] + high[c] == 0:
            continue
        a = begin[c]
        while a < head[c]:  # runs of one byte are induced inside their own bucket
            found = order[a : head[c]]
            a = head[c]
            before = found[found > 0] - 1
            before = before[induced[before] & (t[before] == c)]
            order[a : a + len(before)] = before
            head[c] += len(before)
        induce(order[begin[c] : head[c]], c)
        last = order[begin[c] + low[c] : begin[c + 1]]
        last[:] = direct[cut[c] : cut[c + 1]]
        induce(last, c)
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, in bytes, up to depth."""
    word = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    out, live = np.full(len(a), depth), np.arange(len(a))
    for k in range(0, depth, 8):
        differ = word[a[live] + k] ^ word[b[live] + k]
        off = differ != 0
        low = differ[off] & (~differ[off] + np.uint64(1))
        out[live[off]] = np.minimum(depth, k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        live = live[~off]
    return out


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part, which of its starts begin a string that begins at another start, in this or another part."""
    joined = b"\xff".join(parts) + b"\xff"
    text = np.concatenate([np.frombuffer(joined, np.uint8) + np.uint8(1), np.zeros(length + 8, np.uint8)])  # 0xff, in no UTF-8, becomes 0
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    starts = np.maximum(sizes - length + 1, 0)
    place = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(begin, starts)
    flags = np.zeros(len(text), bool)
    if len(place):
        need = np.zeros(len(text), bool)
        need[place] = True
        t = text.astype(np.int16)
        change = np.flatnonzero(np.diff(t))
        last = (begin + starts - 1)[starts > 0]
        for p in last.tolist():  # behind the last start of a part, as far as its order is induced
            k = int(np.searchsorted(change, p))
            while k < len(change) and t[change[k] + 1] < t[change[k]]:
                k += 1
            stop = change[k] if k < len(change) else len(t) - length - 1
            need[p : stop + 1] = True
        used = np.flatnonzero(need[: len(text) - length])
        order = two_stage(text, used, length)
        start = np.zeros(len(text), bool)
        start[place] = True
        order = order[start[order]]
        same = common_prefix(text, order[:-1], order[1:], length) >= length
        flags[order[:-1][same]] = True
        flags[order[1:][same]] = True
    return [flags[b : b + s] for b, s in zip(begin, starts)]


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.tolist()


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(x: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(x)
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


FRAGMENT = ["gram", "fa", "fb"]
#: Strings of a bucket, on average, and fragments of a row, where strings are counted by digest.
STRINGS, ROW = 200_000, 256
COUNTED = np.dtype([("xa", "<i8"), ("xb", "<i8"), ("n", "u1")])
STRING = np.dtype([("xa", "<i8"), ("xb", "<i8"), ("part", "<u4"), ("at", "<u4")])


def _digests(part: bytes, length: int) -> np.ndarray:
    """Digests of the strings at all starts of a fragment, as two numbers each."""
    d = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([d(part[j : j + length]) for j in range(len(part) - length + 1)]), "<i8").reshape(-1, 2)


def _tally(length: int, buckets: int, held: int = 1 << 19):
    """The distinct digests of the strings of many fragments, each with 1 or 2 (more than once, or in a fragment that repeats whole)."""

    def send(digests: list, weights: list) -> pa.RecordBatch:
        x, w = np.concatenate(digests), np.concatenate(weights)
        order = np.lexsort((x[:, 1], x[:, 0]))
        x, w = x[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
        row = np.zeros(len(first), COUNTED)
        row["xa"], row["xb"], row["n"] = x[first, 0], x[first, 1], np.minimum(np.add.reduceat(w, first), 2)
        bucket = row["xa"] % buckets
        row = row[np.argsort(bucket, kind="stable")]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        used = [i for i in range(buckets) if ends[i] > (ends[i - 1] if i else 0)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([row[(ends[i - 1] if i else 0) : ends[i]].tobytes() for i in used], pa.binary())], names=["bucket", "strings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, weights, n = [], [], 0
        for b in batches:
            for i, full in enumerate(b.column("full").to_pylist()):
                d = _digests(b.column("part")[i].as_py(), length)
                digests.append(d)
                weights.append(np.full(len(d), 1 + full))
                n += len(d)
                if n >= held:
                    yield send(digests, weights)
                    digests, weights, n = [], [], 0
        if n:
            yield send(digests, weights)

    return run


def _repeated_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the digests that come more than once."""
    for t in complete_groups(batches, ["bucket"]):
        x = np.frombuffer(b"".join(t.column("strings").to_pylist()), COUNTED)
        x = x[np.lexsort((x["xb"], x["xa"]))]
        first = np.flatnonzero(np.concatenate([[True], (x["xa"][1:] != x["xa"][:-1]) | (x["xb"][1:] != x["xb"][:-1])]))
        again = first[np.add.reduceat(x["n"].astype(np.int64), first) > 1]
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([x["xa"][again], x["xb"][again]], axis=1).astype("<i8").tobytes()], pa.binary())], names=["strings"])


def _among(d: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which digests are among the known ones, which are sorted."""
    out, at = np.zeros(len(d), bool), np.searchsorted(known[:, 0], d[:, 0])
    live = np.arange(len(d))
    while len(live):  # once more only where two known digests begin alike
        live, at = live[at < len(known)], at[at < len(known)]
        same = known[at, 0] == d[live, 0]
        live, at = live[same], at[same]
        hit = known[at, 1] == d[live, 1]
        out[live[hit]] = True
        live, at = live[~hit], at[~hit] + 1
    return out


def _mark(length: int, shared):
    """Spans, by fragment, of the strings whose digest is among the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, "<i8").reshape(-1, 2)
        for b in batches:
            row, found = [], []
            for i, (s, full) in enumerate(zip(b.column("s").to_pylist(), b.column("full").to_pylist())):
                if not full:
                    flags = _among(_digests(b.column("part")[i].as_py(), length), known)
                    if flags.any():
                        row.append(i)
                        found.append([s + k + (length - 1) * (j % 2) for j, k in enumerate(_runs(flags))])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])

    return run


def _pack(length: int, buckets: int):
    """The strings at all starts of crowded fragments: a row for some fragments and each bucket of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROW):
                b = batch.slice(k, ROW)
                parts = [_digests(p, length) for p in b.column("part").to_pylist()]
                strings = np.zeros(sum(map(len, parts)), STRING)
                strings["xa"], strings["xb"] = np.concatenate(parts).T
                strings["part"], strings["at"] = np.repeat(np.arange(len(parts)), [len(d) for d in parts]), np.concatenate([np.arange(len(d)) for d in parts])
                bucket = (strings["xa"] % buckets).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                strings = strings[order]
                used = [i for i in range(buckets) if ends[i] > (ends[i - 1] if i else 0)]
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)).take(pa.array([0] * len(used))) for c in ("doc_id", "th", "s", "full")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), *lists, pa.array([strings[(ends[i - 1] if i else 0) : ends[i]].tobytes() for i in used], pa.binary())],
                    names=["bucket", "doc_id", "th", "s", "full", "strings"])

    return run


def _count(length: int):
    """Spans, by fragment, of the strings that come more than once; all strings of a digest are in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, ["bucket"]):
            ids = {c: [x for xs in t.column(c).to_pylist() for x in xs] for c in ("th", "s", "full")}
            docs = pa.concat_arrays([x.flatten() for x in t.column("doc_id").chunks])
            parts, at = [], 0
            for raw, n in zip(t.column("strings").to_pylist(), [len(x) for x in t.column("th").to_pylist()]):
                x = np.frombuffer(raw, STRING).copy()
                x["part"] += at
                at += n
                parts.append(x)
            x = np.concatenate(parts)
            x = x[np.lexsort((x["xb"], x["xa"]))]
            new = np.concatenate([[True], (x["xa"][1:] != x["xa"][:-1]) | (x["xb"][1:] != x["xb"][:-1])])
            group = np.cumsum(new) - 1
            full = np.array(ids["full"], bool)
            weight = np.bincount(group, 1.0 + full[x["part"]])
            hit = x[(weight[group] > 1) & ~full[x["part"]]]
            hit = hit[np.lexsort((hit["at"], hit["part"]))]
            edge = np.flatnonzero(np.concatenate([[True], hit["part"][1:] != hit["part"][:-1], [True]])) if len(hit) else np.zeros(1, np.int64)
            part = hit["part"][edge[:-1]].astype(np.int64)
            starts = [(hit["at"][a:b].astype(np.int64) + ids["s"][p]).tolist() for a, b, p in zip(edge, edge[1:], part.tolist())]
            yield pa.RecordBatch.from_arrays([
                docs.take(pa.array(part)), pa.array([ids["th"][p] for p in part.tolist()], pa.int64()),
                pa.array([merged([(k, k + length) for k in xs]) for xs in starts], pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])

    return run


def dedup_spans(docs: DataFrame, length: int, crowd: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, th, spans (starts and ends in turn) of the documents that lose bytes; docs: doc_id, th, text."""
    kind = docs.schema["doc_id"].dataType
    kind_sql = kind.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            data, offsets = text_bytes(batch.column("text"))
            text, start, n, gram = fragments(data, offsets, length)
            raw = data.tobytes()
            d = [_digest(raw[s : s + k - 1 + length]) for s, k in zip(start.tolist(), n.tolist())]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(gram.view(np.int64)),
                pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(start - offsets[text]), pa.array(n),
            ], names=["doc_id", "th", "gram", "fa", "fb", "s", "n"])

    every = stored(docs.mapInArrow(cut, f"doc_id {kind_sql}, th long, gram long, fa long, fb long, s long, n long"), "suffix-fragments")
    distinct = every.groupBy(*FRAGMENT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "s", "n")).alias("one"))
    grams = distinct.groupBy("gram").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    known = stored(distinct.join(grams.drop("total").hint("merge"), "gram"), "suffix-kinds")
    whole = every.join(known.filter("copies > 1").select(*FRAGMENT).hint("merge"), FRAGMENT).select(
        "doc_id", "th", F.array("s", F.col("s") + F.col("n") - 1 + length).alias("spans"))

    wanted = known.filter("kinds > 1").groupBy("one.doc_id", "one.th").agg(
        F.collect_list(F.struct("gram", "fa", "fb", F.col("one.s").alias("s"), F.col("one.n").alias("n"), (F.col("copies") > 1).alias("full"), (F.col("kinds") > crowd).alias("crowded"))).alias("parts"))
    item = wanted.schema["parts"].dataType.elementType

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            texts, ids = bytes_list(batch.column("text")), batch.column("doc_id")
            row, out = [], {f.name: [] for f in item.fields}
            part = []
            for i, ps in enumerate(batch.column("parts").to_pylist()):
                for p in ps:
                    row.append(i)
                    for k, v in p.items():
                        out[k].append(v)
                    part.append(texts[i][p["s"] : p["s"] + p["n"] - 1 + length])
            take = pa.array(row, pa.int64())
            types = {"full": pa.bool_(), "crowded": pa.bool_()}
            yield pa.RecordBatch.from_arrays([ids.take(take), batch.column("th").take(take), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items()), pa.array(part, pa.binary())], names=["doc_id", "th", *out, "part"])

    wanted = _checked(wanted, "suffix-wanted", "parts", 80, broadcast_bytes)
    texts = docs.join(wanted, docs.th.eqNullSafe(wanted.th) & docs.doc_id.eqNullSafe(wanted.doc_id)).select(docs.doc_id, docs.th, "text", "parts")
    texts = stored(texts.mapInArrow(fetch, f"doc_id {kind_sql}, th long, gram long, fa long, fb long, s long, n long, full boolean, crowded boolean, part binary"), "suffix-texts")
    # rows with equal doc_id and text fetch the same fragment more than once
    texts = texts.dropDuplicates(["gram", "fa", "fb"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t in complete_groups(batches, ["gram"]):
            held.append(t)
            size += t.column("part").nbytes
            if size > BATCH:
                yield from solve(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from solve(pa.concat_tables(held))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = t.column("gram").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
        parts, s, full = t.column("part").to_pylist(), t.column("s").to_numpy(), t.column("full").to_numpy()
        a = 0
        while a < len(edge) - 1:  # some groups at a time
            b, size = a, 0
            while b < len(edge) - 1 and (b == a or size < BATCH):
                size += sum(map(len, parts[edge[b] : edge[b + 1]]))
                b += 1
            rows = range(edge[a], edge[b])
            row, found = [], []
            for i, flags in zip(rows, repeated([parts[i] for i in rows], length)):
                if not full[i] and flags.any():
                    x = _runs(flags)
                    row.append(i)
                    found.append([int(s[i]) + k + (length - 1) * (j % 2) for j, k in enumerate(x)])
            if row:
                c = t.select(["doc_id", "th"]).take(pa.array(row)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])
            a = b

    spans = f"doc_id {kind_sql}, th long, spans array<long>"
    usual = texts.filter("NOT crowded").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, spans)

    found = [whole, usual]
    crowded = known.filter(F.col("kinds") > crowd).agg(F.sum("one.n")).first()[0]
    if crowded:
        buckets, some = -(-crowded // STRINGS), texts.filter("crowded")
        counted = some.mapInArrow(_tally(length, buckets), "bucket int, strings binary").repartition("bucket").sortWithinPartitions("bucket")
        again = stored(counted.mapInArrow(_repeated_digests, "strings binary"), "suffix-repeated")
        if (again.agg(F.sum(F.octet_length("strings"))).first()[0] or 0) <= broadcast_bytes:
            known = np.concatenate([np.zeros((0, 2), "<i8"), *(np.frombuffer(r["strings"], "<i8").reshape(-1, 2) for r in again.collect())])
            shared = docs.sparkSession.sparkContext.broadcast(known[np.lexsort((known[:, 1], known[:, 0]))].tobytes())
            found.append(some.mapInArrow(_mark(length, shared), spans))
        else:
            packed = some.mapInArrow(_pack(length, buckets), f"bucket int, doc_id array<{kind_sql}>, th array<long>, s array<long>, full array<boolean>, strings binary")
            found.append(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(length), spans))
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([merged([(x[k], x[k + 1]) for x in xs for k in range(0, len(x), 2)]) for xs in b.column("spans").to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])

    return marks.groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans")).mapInArrow(join, StructType().add("doc_id", kind).add("th", LongType()).add("spans", ArrayType(LongType())))


def _checked(df: DataFrame, name: str, items: str, item_bytes: int, max_bytes: int) -> DataFrame:
    """Stored, and marked for broadcast if it has at most max_bytes: 64 a row and item_bytes an entry of its arrays."""
    df = stored(df, name)
    n = df.agg(F.sum(F.size(items) * item_bytes + 64)).first()[0] or 0
    return F.broadcast(df) if n <= max_bytes else df.hint("merge")


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1024, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, spans (removed: starts and ends in turn), kept (binary) of every row."""
    if length < GRAM + 8 or length % 8:
        raise ValueError(f"length must be a multiple of 8 from {GRAM + 8}")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = _checked(dedup_spans(docs, length, crowd, broadcast_bytes), "suffix-spans", "spans", 8, broadcast_bytes)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            out, sizes = [], []
            for x, s in zip(bytes_list(batch.column("text")), batch.column("spans").to_pylist()):
                sizes.append(len(x))
                edges = [0, *(s or []), len(x)]
                out.append(b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2])) if s else x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("spans"), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    both = docs.join(spans, docs.th.eqNullSafe(spans.th) & docs.doc_id.eqNullSafe(spans.doc_id), "left").select(
        docs.doc_id, "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    return both.mapInArrow(remove, StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_bytes", LongType()).add("spans", ArrayType(LongType())).add("kept", BinaryType()))
