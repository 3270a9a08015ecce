"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of bounded size. A segment is one row of the index table in the shared
folder: its documents, its terms, and for each term the sorted positions of its postings. Positions run over the
segment with a gap between documents, so no phrase crosses a document. A search takes a batch of phrases to
every segment, starts each phrase from the postings of its rarest term there, shifts them by the term's offset and
intersects them with the shifted postings of the other terms, rarest first. Matches are merged by document.

The index is built once, whatever the number of test items. With few items it holds only words that occur in them: no
phrase can ask for others; with more it holds all words, named by a hash, and different items go out in blocks of about block_bytes, so
what is collected and broadcast at a time doesn't grow with the benchmark; each block is a scan of the index. A term with a third of all
postings is spread over all segments.

Words are runs of digits, letters and non-ASCII bytes after lower-casing A-Z. Defined results: null text has no
words; a phrase in no document gives nothing; repeated rows are documents of their own; an empty table gives no rows; an
item without an id hits words like any other, but names no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

from .arrow import bytes_list, pieces
from .util import bound_batches, stored

#: Bytes that words consist of stay (A-Z in lower case), all others become blanks.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SEGMENT_BYTES = 2 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def code(word: bytes) -> int:
    """The name of a term: a signed 64-bit hash, never 0."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h or 1


class Codes(dict):
    """Names of words: of given ones only (0 for all others), or of any, kept for a while."""

    def __init__(self, words: set[bytes] | None = None):
        super().__init__((w, code(w)) for w in words or ())
        self.every = words is None

    def __missing__(self, word: bytes) -> int:
        if not self.every:
            return 0
        if len(self) > 400_000:
            self.clear()
        self[word] = c = code(word)
        return c


def segment(name: str, ids: list, texts: list[bytes], codes: Codes) -> dict:
    """The positional index of some documents: postings of each term as sorted positions."""
    rows = [words(x) for x in texts]
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.concatenate([[0], np.cumsum(n + 1)])  # the gap of 1 parts documents
    get = codes.__getitem__
    term = np.zeros(start[-1], np.int64)
    for s, ws in zip(start, rows):
        term[s : s + len(ws)] = np.fromiter(map(get, ws), np.int64, len(ws))
    at = np.flatnonzero(term)
    at = at[np.argsort(term[at], kind="stable")]
    found, counts = np.unique(term[at], return_counts=True)
    delta = np.diff(at, prepend=0).astype(np.int32)
    return {"name": name, "doc_ids": ids, "n_words": n.tolist(), "terms": found.tolist(), "counts": counts.tolist(), "postings": zstandard.compress(delta.tobytes(), 1)}


def search(seg: dict, phrases: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every occurrence; phrases: rows of places in codes (names of terms), lengths: of each row."""
    none = np.zeros(0, np.int64)
    terms, counts = np.asarray(seg["terms"], np.int64), np.asarray(seg["counts"], np.int64)
    if not len(terms) or not len(phrases):
        return none, none
    pos = np.cumsum(np.frombuffer(zstandard.decompress(seg["postings"]), np.int32), dtype=np.int64)
    rank = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
    freq = np.where(terms[rank] == codes, counts[rank], 0)
    first = (np.cumsum(counts) - counts)[rank]
    width = phrases.shape[1]
    used = np.arange(width) < lengths[:, None]
    f = np.where(used, freq[phrases], np.iinfo(np.int64).max)
    live = np.flatnonzero(f.min(1) > 0)
    order = np.argsort(f[live], axis=1, kind="stable")  # rarest term first
    at = order[:, 0]
    t = phrases[live, at]
    m = freq[t]
    phrase = np.repeat(np.arange(len(live)), m)
    where = pos[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[t], m)] - np.repeat(at, m)
    span = int(pos.max()) + width + 2
    postings = np.repeat(np.arange(len(terms)), counts) * span + pos
    for k in range(1, width):
        if not len(phrase):
            break
        off = order[phrase, k]
        due = off < lengths[live[phrase]]
        key = rank[phrases[live[phrase], off]] * span + where + off
        hit = np.searchsorted(postings, key)
        ok = (postings[np.minimum(hit, len(postings) - 1)] == key) & (where + off >= 0)
        keep = ok | ~due
        phrase, where = phrase[keep], where[keep]
    return live[phrase], where


def near(seg: dict, terms: list[int], within: int) -> list[tuple[int, int]]:
    """Proximity matches: (document's row, first position in it) of spans of at most `within` words with all terms.

    From every posting of the rarest term, the nearest posting of each other term must lie in one such span.
    """
    lists, at = {}, 0
    pos = np.cumsum(np.frombuffer(zstandard.decompress(seg["postings"]), np.int32), dtype=np.int64)
    for t, n in zip(seg["terms"], seg["counts"]):
        lists[t] = pos[at : at + n]
        at += n
    if any(t not in lists for t in terms):
        return []
    start = np.concatenate([[0], np.cumsum(np.asarray(seg["n_words"]) + 1)])
    out = set()
    rare = min(terms, key=lambda t: len(lists[t]))
    for p in lists[rare].tolist():
        doc = int(np.searchsorted(start, p, side="right")) - 1
        for lo in sorted({int(q) for t in terms for q in lists[t][np.searchsorted(lists[t], max(p - within + 1, start[doc])) : np.searchsorted(lists[t], p, side="right")]}):
            end = min(lo + within, start[doc + 1] - 1)
            if p < end and all(np.searchsorted(lists[t], lo) < np.searchsorted(lists[t], end) for t in terms):
                out.add((doc, lo - int(start[doc])))
    return sorted(out)


def windows(items: list[tuple[str | None, list[bytes]]], n: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item names, names of terms, and of each distinct (item, window): places of its terms, length and item number."""
    vocabulary = sorted({w for _, ws in items for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    names, rows, item = [name for name, _ in items], [], []
    for i, (_, ws) in enumerate(items):
        t = [number[w] for w in ws]
        for row in dict.fromkeys(tuple(t[k : k + n]) for k in range(max(1, len(t) - n + 1))):
            rows.append(row)
            item.append(i)
    out = np.zeros((len(rows), n), np.int64)
    for r, row in enumerate(rows):
        out[r, : len(row)] = row
    return names, np.array([code(w) for w in vocabulary], np.int64), out, np.array([len(r) for r in rows], np.int64), np.array(item, np.int64)


SEGMENT = (StructType().add("name", StringType()).add("doc_ids", ArrayType(LongType())).add("n_words", ArrayType(LongType())).add("terms", ArrayType(LongType()))
           .add("counts", ArrayType(IntegerType())).add("postings", BinaryType()))


def build_index(docs: DataFrame, words: set[bytes] | None = None) -> DataFrame:
    """The stored index of these words, or of all, one row a segment; docs has doc_id (long) and text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = Codes(shared.value), TaskContext.get().partitionId()
        for k, batch in enumerate(pieces(batches, "text", SEGMENT_BYTES)):
            seg = segment(f"{part}-{k}", batch.column("doc_id").to_pylist(), bytes_list(batch.column("text")), codes)
            yield pa.RecordBatch.from_pylist([seg], schema=ARROW)

    return stored(docs.select("doc_id", "text").mapInArrow(run, SEGMENT), "positional-index")


ARROW = pa.schema([("name", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("segment", pa.string()), ("row", pa.int64())])


def _spans(index: DataFrame, items: list[tuple[str | None, list[bytes]]], n: int) -> DataFrame:
    """Of every document: hit spans (start and end in turn) and items with windows in it."""
    shared = index.sparkSession.sparkContext.broadcast(windows(items, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, phrases, lengths, item = shared.value
        for batch in batches:
            for seg in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                words = np.asarray(seg["n_words"], np.int64)
                start = np.concatenate([[0], np.cumsum(words + 1)])
                phrase, at = search(seg, phrases, lengths, codes)
                order = np.argsort(at, kind="stable")
                phrase, at = phrase[order], at[order]
                doc = np.searchsorted(start, at, side="right") - 1
                out = []
                cut = np.searchsorted(doc, np.arange(len(words) + 1))
                for d in range(len(words)):
                    a, b = cut[d], cut[d + 1]
                    spans, of = [], []
                    if b > a:
                        of = sorted({names[i] for i in item[phrase[a:b]]} - {None})
                        for s, e in zip((at[a:b] - start[d]).tolist(), (at[a:b] - start[d] + lengths[phrase[a:b]]).tolist()):
                            if spans and s <= spans[-1]:
                                spans[-1] = max(spans[-1], e)
                            else:
                                spans += [s, e]
                    out.append({"doc_id": seg["doc_ids"][d], "n_words": int(words[d]), "n_hit": sum(spans[1::2]) - sum(spans[::2]), "hits": spans, "items": of, "segment": seg["name"], "row": d})
                yield pa.RecordBatch.from_pylist(out, schema=HITS)

    return index.mapInArrow(run, StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_hit", LongType()).add("hits", ArrayType(LongType())).add("items", ArrayType(StringType())).add("segment", StringType()).add("row", LongType()))


def merged(spans: list[list[int]]) -> list[int]:
    """The union of span lists, as one sorted list of starts and ends in turn."""
    out: list[int] = []
    for s, e in sorted((x[k], x[k + 1]) for x in spans for k in range(0, len(x), 2)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(table: DataFrame, block_bytes: int) -> Iterator[tuple[int, list[tuple[str | None, list[bytes]]]]]:
    """How many blocks there are, and the items of each, as words; items without words are left out, equal ones are one."""
    rows = table.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    blocks = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for k in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield blocks, [(r["item_id"], ws) for r in sorted(own, key=lambda r: (r["item_id"] is None, r["item_id"] or "", r["text"])) if (ws := words(r["text"].encode()))]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, hits, items of every document; docs: doc_id, text; benchmark: item_id, text.

    hits: starts and ends of the hit spans in words, in turn. Items of the benchmark go out in blocks of about
    block_bytes of text; with more than one block, spans are merged by document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, out, many = None, None, False
    for blocks, items in _blocks(benchmark, block_bytes):
        if index is None:
            many = blocks > 1
            index = build_index(docs, None if many else {w for _, ws in items for w in ws})
        found = _spans(index, items, n)
        out = found if out is None else out.unionByName(found)
    if many:
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [merged(x) for x in b.column("hits").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array([sum(x[1::2]) - sum(x[::2]) for x in hits], pa.int64()), pa.array(hits, pa.list_(pa.int64())), b.column("items")], names=["doc_id", "n_words", "n_hit", "hits", "items"])

        by = out.groupBy("segment", "row", "doc_id", "n_words").agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = by.select("doc_id", "n_words", "hits", "items").mapInArrow(join, "doc_id long, n_words long, n_hit long, hits array<long>, items array<string>")
    return out.select("doc_id", "n_words", "n_hit", "hits", "items")


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, position of each span of at most `within` words that begins with, and holds, all words of a query.

    docs: doc_id, text; queries: item_id, text, searched in blocks of about block_bytes. Queries without words match nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, out = None, None
    for blocks, items in _blocks(queries, block_bytes):
        if index is None:
            index = build_index(docs, None if blocks > 1 else {w for _, ws in items for w in ws})
        found = _near(index, [(name, sorted({code(w) for w in ws})) for name, ws in items], within)
        out = found if out is None else out.unionByName(found)
    return out


def _near(index: DataFrame, queries: list[tuple[str | None, list[int]]], within: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                hits = [(seg["doc_ids"][d], name, p) for name, ts in shared.value for d, p in near(seg, ts, within)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits), (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "item_id", "position"])

    return index.mapInArrow(run, "doc_id long, item_id string, position long")


def is_contaminated(n_hit, n_words):
    return ((n_hit > 0) & (20 * n_hit >= n_words)).cast(BooleanType())
