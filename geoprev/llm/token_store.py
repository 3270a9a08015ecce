"""Token-ID / binary output: a content-addressed store of id streams.

A rolling hash over 12 ids cuts each document's ids into chunks where the content says so, so equal passages
become equal chunks. A chunk is named by a digest of its ids and stored once (zstandard, little-endian ids of
`width` bytes). A document's recipe lists its chunks; recipes lie in ascending doc_id order and carry the
number of ids before them. Digests form a Merkle tree: chunks to a document's root; index, doc_id, start, length and root of
a document to a leaf; each FANOUT leaves to a node, each FANOUT nodes to one of the next level, up to the root of the store.
Reading makes the tree anew from the recipes and compares all its nodes; a recipe's chunks are checked against its root
and every chunk against its digest when they are read.

    rows/     kind=chunk: key (digest), n, data
    recipes/  index, doc_id, start, n_tokens, digests, lengths, root
    manifest/ level, node, root: all nodes of the tree
    root/     n_docs, n_tokens, root of the store

Skew: a chunk that a third of all documents share leaves a task once (recently seen digests are kept) and is met
by digest only as a row of a few bytes; reading a document's checksum moves checksums of chunks, not chunks.
Chunks are written by one shuffle, recipes by a range of (doc_id, row), so no document id fills a task. No group of the
tree has more than FANOUT members.

Tokenizing splits at ASCII white space, which no token of a tokenizer that drops white space crosses, and encodes
each distinct word once per worker; the ids are those of encoding whole texts.

Defined results: null text counts as empty (only the end id); repeated rows are kept, in the order of their input
row; a null doc_id comes first; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import pieces
from .util import bound_batches, drop_dir, shared_dir, stored

WINDOW = 12
MEAN = 10  # a chunk has about 2 ** MEAN ids
LONGEST = 1 << 13
FANOUT = 1 << 10
GEAR = np.random.default_rng(97).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
CACHE = 600_000
TAIL, LETTERS = ".,;:!?&%$#*)", r"^\pL+$"
#: Letters, the last of them one that stays a letter when normalised and lower-cased (Latin without the dotted capital I).
CUT = r"^\pL*[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{017F}]$"
_ENCODERS: dict = {}


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of an id stream of documents that end at `ends`; no chunk crosses a document."""
    g = GEAR[ids & 0xFFFF]
    h = g.copy()
    for j in range(1, min(WINDOW, len(ids))):
        h[j:] += g[:-j] << np.uint32(j)
    at = np.flatnonzero((h >> np.uint32(WINDOW)) & np.uint32((1 << MEAN) - 1) == 0) + 1
    begin = np.concatenate([[0], ends[:-1]])
    at = at[at - begin[np.searchsorted(ends, at)] >= WINDOW]  # the window lies inside the document
    at = np.unique(np.concatenate([at, ends]))
    lengths = np.diff(at, prepend=0)
    if (lengths > LONGEST).any():
        at = np.concatenate([np.append(np.arange(e - n + LONGEST, e, LONGEST), e) for e, n in zip(at, lengths)])
    return at


def _data(strings: pa.Array) -> pa.Buffer:
    """The bytes of all strings in a row."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return strings.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(strings) and strings.buffers()[2] else pa.py_buffer(b"")


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values, one behind the other."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat((start - ends + size).astype(np.int32 if max(len(values), total) < 1 << 31 else np.int64), size) + np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)]


class WordEncoder:
    """Ids of texts; words between ASCII white space are encoded once and kept while the worker lives.

    A word of letters with punctuation behind it counts as two pieces, which no token crosses. Words are split, told apart and
    looked up by Arrow; only new pieces meet the tokenizer, many at a time.
    """

    MARK = "\x02"  # between pieces that are encoded together

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.width = Tokenizer.from_file(path), width
        mark = self._ids(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or "\x00"
        self.last = np.zeros(max(self.tokenizer.get_vocab_size(), *vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    @classmethod
    def of(cls, path: str, width: int) -> WordEncoder:
        if (path, width) not in _ENCODERS:
            _ENCODERS[path, width] = cls(path, width)
        return _ENCODERS[path, width]

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())  # pieces, and of each the first of its ids and their number
        self.start = self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, f"<u{self.width}")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with marks between them, and how many each has."""
        ids = self._ids(f" {self.MARK} ".join([*pieces, ""])) if self.mark is not None else np.zeros(0)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(pieces):
            return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        each = [self._ids(x) for x in pieces]  # a piece holds the mark
        return np.concatenate(each), np.array([len(x) for x in each])

    def _letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters only: of each, the last token and no other ends a word."""
        ids = self._ids(" ".join(pieces))
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(pieces) else self._apart(pieces)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode new pieces; the place of each among the known ones."""
        letters = pc.match_substring_regex(pieces, LETTERS)
        place, base = np.zeros(len(pieces), np.int64), len(self.known)
        for mask, encode in ((letters, self._letters), (pc.invert(letters), self._apart)):
            part = pieces.filter(mask)
            found = [encode(part.slice(k, 1024).to_pylist()) for k in range(0, len(part), 1024)]
            if found:
                size = np.concatenate([n for _, n in found])
                self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
                self.size = np.concatenate([self.size, size.astype(np.int32)])
                self.ids = np.concatenate([self.ids, *(x for x, _ in found)])
                self.known = pa.concat_arrays([self.known, part])
                place[mask.to_numpy(zero_copy_only=False)] = base + np.arange(len(part))
                base += len(part)
        return place

    def _halves(self, words: pa.Array) -> pa.Array:
        """Each word as two pieces, one behind the other: letters and the punctuation behind them, or the word and nothing."""
        core = pc.ascii_rtrim(words, characters=TAIL)
        cut = pc.and_(pc.match_substring_regex(core, CUT), pc.invert(pc.match_substring(words, "<|")))
        core = pc.if_else(cut, core, words)
        n = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (core, words)], axis=1)
        n[:, 1] -= n[:, 0]
        offsets = np.concatenate([[0], np.cumsum(n.ravel())]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(offsets.tobytes()), _data(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy of its own: ascii_lower errs on slices
        # lower-casing A-Z is the tokenizer's own doing; ahead of it, it is safe where nothing composes and no special token is spelt
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        split = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
        words = split.flatten().dictionary_encode()
        pieces = self._halves(words.dictionary).dictionary_encode()
        at = pc.index_in(pieces.dictionary, value_set=self.known)
        if len(self.known) + at.null_count > CACHE:
            self._forget()
            at = pa.nulls(len(at), pa.int32())
        new = pc.is_null(at)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            place[new.to_numpy(zero_copy_only=False)] = self._learn(pieces.dictionary.filter(new))
        half = place[pieces.indices.to_numpy(zero_copy_only=False)]
        size = self.size[half].reshape(-1, 2).sum(1, dtype=np.int64)
        every = _gather(self.ids, self.start[half], self.size[half])
        word = words.indices.to_numpy(zero_copy_only=False)
        out = _gather(every, (np.cumsum(size) - size)[word], size[word])
        ends = np.concatenate([[0], np.cumsum(size[word])])
        return out, np.diff(ends[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))], prepend=0)


def drops_space(path: str) -> bool:
    """Whether a tokenizer file drops white space between words, so that words are encoded independently."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "[^\\s" in s["pattern"].get("Regex", "") for s in steps)


def settled(docs: DataFrame) -> DataFrame:
    """docs itself if its tasks read the same rows whenever they run (files, or literal rows), else a written copy."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    steps = set(re.findall(r"^[\s:+\-*()\d]*([A-Z][A-Za-z]+)", plan, re.M))
    return docs if steps <= {"FileScan", "LocalTableScan", "Range", "ColumnarToRow", "Project", "Filter", "Union"} else stored(docs, "token-input")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 2, path: str | None = None) -> str:
    """Encode docs (doc_id, text), write the store and return its path; ids must fit width bytes.

    Recipes are named by task and row, so a task that runs again has to read the same rows: input that isn't read from files is written first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or shared_dir(spark, "token-store")
    if not drops_space(tokenizer):
        raise ValueError("the tokenizer keeps white space; its words can't be encoded one by one")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press, seen = WordEncoder.of(tokenizer, width), zstandard.ZstdCompressor(level=1), {}
        part, row = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", 4 << 20):
            ids, counts = encoder.encode(batch.column("text"))
            recipe: dict = {"key": [], "digests": [], "lengths": [], "root": []}
            chunk: dict = {"key": [], "n": [], "data": []}
            ids = np.insert(ids, np.cumsum(counts), end_id)
            ends = np.cumsum(counts + 1)
            at, stream = cuts(ids, ends), ids.tobytes()
            lengths = np.diff(at, prepend=0).tolist()
            names, a = [], 0
            for e, n in zip((width * at).tolist(), lengths):
                piece = stream[a:e]
                names.append(name := digest(piece))
                if name not in seen:
                    seen[name] = True
                    chunk["key"].append(name)
                    chunk["n"].append(n)
                    chunk["data"].append(press.compress(piece))
                a = e
            a = 0
            for e in (np.searchsorted(at, ends) + 1).tolist():
                recipe["key"].append(part.to_bytes(8, "big") + row.to_bytes(8, "big"))
                recipe["digests"].append(names[a:e])
                recipe["lengths"].append(lengths[a:e])
                recipe["root"].append(merkle(names[a:e]))
                row += 1
                a = e
            if len(seen) > CACHE:
                seen.clear()
            n, m = len(counts), len(chunk["key"])
            doc = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([
                pa.array(["recipe"] * n + ["chunk"] * m), pa.array(recipe["key"] + chunk["key"], pa.binary()),
                pa.concat_arrays([doc, pa.nulls(m, doc.type)]), pa.array(recipe["digests"] + [None] * m, pa.list_(pa.binary())),
                pa.array(recipe["lengths"] + [None] * m, pa.list_(pa.int32())), pa.array(recipe["root"] + [None] * m, pa.binary()),
                pa.array([None] * n + chunk["n"], pa.int32()), pa.array([None] * n + chunk["data"], pa.binary()),
            ], names=["kind", "key", "doc_id", "digests", "lengths", "root", "n", "data"])

    rows = settled(docs.select("doc_id", "text")).mapInArrow(run, f"kind string, key binary, doc_id {id_type}, digests array<binary>, lengths array<int>, root binary, n int, data binary")
    rows.repartition("kind", "key").dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    recipes = stored.filter("kind = 'recipe'").select("doc_id", "key", "digests", "lengths", "root", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_tokens"))
    recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key").withColumn(
        "part", F.spark_partition_id()).write.parquet(f"{path}/sorted")
    placed = spark.read.parquet(f"{path}/sorted")
    parts, tokens, docs_before = [], 0, 0
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).orderBy("part").collect():  # a row for each range of documents
        parts.append((r["part"], tokens, docs_before))
        tokens, docs_before = tokens + r["n_tokens"], docs_before + r["n_docs"]
    ranges = spark.createDataFrame(parts, "part int, tokens long, docs long")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    local = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed.withColumns({"local": local, "nth": F.row_number().over(inside) - 1}).join(F.broadcast(ranges), "part").select(
        (F.col("docs") + F.col("nth")).alias("index"), "doc_id", (F.col("tokens") + F.col("local")).alias("start"), "n_tokens", "digests", "lengths", "root").write.parquet(f"{path}/recipes")
    drop_dir(spark, f"{path}/sorted")
    level, nodes = 1, _nodes(_leaves(spark.read.parquet(f"{path}/recipes")))
    while True:
        nodes.write.parquet(f"{path}/manifest/level={level}")
        stored = spark.read.schema(NODE).parquet(f"{path}/manifest/level={level}")
        if stored.count() <= 1:
            break
        level, nodes = level + 1, _nodes(stored)
    top = stored.first()
    spark.createDataFrame([(docs_before, tokens, top["root"] if top else b"")], "n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/root")
    return path


NODE = "node long, root binary"


def _leaves(recipes: DataFrame) -> DataFrame:
    """A digest of what the store says of each document, by its place."""
    said = F.concat_ws("|", "index", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    return recipes.select(F.col("index").alias("node"), F.unhex(F.sha2(said, 256)).alias("root"))


def _nodes(below: DataFrame) -> DataFrame:
    """Nodes over FANOUT members each."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("node", "root"))), lambda x: F.concat_ws(":", x["node"].cast("string"), F.hex(x["root"])))
    return below.groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(F.unhex(F.sha2(F.concat_ws(",", members), 256)).alias("root")).select(F.col("up").alias("node"), "root")


def _differ(a: DataFrame, b: DataFrame) -> int:
    """Nodes that only one of two levels has, or that have other roots."""
    return a.join(b.withColumnRenamed("root", "other"), "node", "full").filter("NOT (root <=> other)").count()


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes of a store, checked against all nodes of its tree and its root."""
    table, top = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/root").first()
    below, level = _nodes(_leaves(table)), 1
    while True:
        stored = spark.read.schema(NODE).parquet(f"{path}/manifest/level={level}")
        if wrong := _differ(stored, below):
            raise ValueError(f"{wrong} nodes of the store differ from its manifest (level {level})")
        if stored.count() <= 1:
            break
        below, level = _nodes(stored), level + 1
    first = stored.first()
    n = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if bytes(first["root"] if first else b"") != bytes(top["root"]) or tuple(n) != (top["n_docs"], top["n_tokens"]):
        raise ValueError("the store differs from its root")
    return table


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, n int, data binary, kind string").parquet(f"{path}/rows").filter("kind = 'chunk'").select(F.col("key").alias("digest"), "n", "data")


def _load(names: list[bytes], data: list[bytes]) -> list[bytes]:
    """The ids of chunks, each checked against its digest."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = list(map(unpack, data))
    for name, x in zip(names, raw):
        if digest(x) != name:
            raise ValueError(f"chunk {name.hex()} does not match its digest")
    return raw


def _check_roots(b: pa.RecordBatch) -> None:
    for names, root in zip(b.column("digests").to_pylist(), b.column("root").to_pylist()):
        if merkle(names) != root:
            raise ValueError("a recipe does not match its root")


POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of CRC polynomials, bits reflected."""
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & 1, b, 0).astype(np.uint32)
        b = (b >> np.uint32(1)) ^ np.where(b & 1, POLY, 0).astype(np.uint32)
    return out


def crc_ahead(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to that of the whole if `after` bytes follow it; the whole's is the XOR."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    power = np.full(1, 1 << 30, np.uint32)  # x
    for _ in range(3):
        power = _times(power, power)  # x ** 8: one byte
    k = 0
    while (after >> k).any():
        due = np.flatnonzero(after >> k & 1)
        crc[due] = _times(np.broadcast_to(power, len(due)), crc[due])
        power = _times(power, power)
        k += 1
    return crc


def checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids as 32-bit words, from the files; roots and digests are checked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _load(b.column("digest").to_pylist(), b.column("data").to_pylist())
            n = [len(x) // width for x in raw]
            wide = memoryview(np.frombuffer(b"".join(raw), f"<u{width}").astype("<u4").tobytes())
            ends = list(accumulate(4 * k for k in n))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64()), pa.array([zlib.crc32(wide[a:e]) for a, e in zip([0, *ends], ends)], pa.int64())], names=["digest", "n", "crc"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = crc_ahead(b.column("crc").to_numpy(zero_copy_only=False), 4 * b.column("after").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n"), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n", "crc"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _check_roots(b)
            lengths = b.column("lengths").to_pylist()
            doc = np.repeat(np.arange(b.num_rows), [len(x) for x in lengths])
            after = [n - a for x in lengths for n in (sum(x),) for a in accumulate(x)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("start").take(take), b.column("digests").flatten(), b.column("lengths").flatten(), pa.array(after, pa.int64())], names=["doc_id", "start", "digest", "length", "after"])

    table = recipes(spark, path)
    kind = table.schema["doc_id"].dataType.simpleString()
    meta = chunks(spark, path).mapInArrow(scan, "digest binary, n long, crc long")
    used = table.select("doc_id", "start", "digests", "lengths", "root").mapInArrow(rooted, f"doc_id {kind}, start long, digest binary, length int, after long")
    met = used.join(meta.hint("merge"), "digest", "left").select(
        "doc_id", "start", "after", "crc", F.when(F.col("n") == F.col("length"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk of a recipe is missing or of other length"))).alias("n"))
    return met.mapInArrow(shift, f"doc_id {kind}, start long, n long, crc long").groupBy("doc_id", "start").agg(
        F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, docs: DataFrame | None = None, width: int = 2) -> DataFrame:
    """doc_id, start, ids of the documents in docs (doc_id), or of all."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, f"<u{width}").astype(np.int32) for x in _load(b.column("digest").to_pylist(), b.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(ids, pa.list_(pa.int32()))], names=["digest", "ids"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _check_roots(b)
            yield b

    table = recipes(spark, path)
    if docs is not None:
        table = table.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    table = table.select("doc_id", "start", "digests", "root")
    used = table.mapInArrow(rooted, table.schema).select("doc_id", "start", F.posexplode("digests").alias("i", "digest"))
    return used.join(chunks(spark, path).mapInArrow(load, "digest binary, ids array<int>"), "digest").groupBy("doc_id", "start").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
