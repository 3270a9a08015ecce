"""Spelling variants: words of a corpus at edit distance one, grouped under the commoner form.

Runs of letters are counted in Arrow batches (RE2 splits whole texts, a dictionary of a batch holds its words once, CRCs of
`<doc_id>:<run>` are put together from a part for the word and one for the document), then by a grouped sum. The words
that are long and common enough are sorted by ranges; consecutive ranges are built into compact tries of bounded size. One trie
after the other is made and broadcast (at most SHARD_WORDS words and SHARD_LETTERS letters, whatever the input); each task intersects
the distance-one Levenshtein automaton of its words with it, depth first, and sends for a word the number of neighbours
and the best one only, which grouped aggregates combine over the tries. Forms are followed to the last by doubling.

Defined results: null text has no runs; a null identifier counts as empty before the colon; repeated rows count each; ties of
n go to the smallest word in code-point order; an empty table gives no rows; columns besides identifier and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trie
from .arrow import pieces
from .util import bound_batches, drop_dir, shared_dir, small, stored

#: Fixed value: letters of a word, after A-Z are lower-cased; everything else parts words.
RUN = "[a-zÀ-ÿ]"
#: Bounds of a trie that is broadcast (about 100 bytes a word and 1 a letter).
SHARD_WORDS, SHARD_LETTERS = 1 << 18, 1 << 23


def _without(word: str, k: int) -> str:
    return word[:k] + word[k + 1 :]


def _counted(ids: pa.Array, texts: pa.Array, least: int, every: int) -> pa.Table:
    """word and n of some rows; a run whose CRC with its document is a multiple of `every` loses a letter (0: none does)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy of its own: ascii_lower errs on slices
    runs = pc.split_pattern_regex(pc.ascii_lower(texts), f"[^{RUN[1:-1]}]+")
    doc, flat = pc.list_parent_indices(runs).to_numpy(), runs.flatten()
    length = pc.utf8_length(flat).to_numpy()
    long = length >= least
    doc, length, code = doc[long], length[long].astype(np.int64), flat.filter(pa.array(long)).dictionary_encode()
    words, index = code.dictionary, code.indices.to_numpy()
    n = np.bincount(index, minlength=len(words)).astype(np.int64)
    if not every or not len(index):
        return pa.table({"word": words.cast(pa.string()), "n": n})
    # crc(prefix + word) = crc(word) ^ crc(prefix + zeros) ^ crc(zeros), zeros as long as the word in bytes
    of_word = np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint32, len(words))
    size = pc.binary_length(words).to_numpy().astype(np.int64)[index]
    pairs, back = np.unique(np.stack([doc, size]), axis=1, return_inverse=True)
    prefix = [f"{x}:".encode() for x in ids.to_pylist()]
    zeros = {k: bytes(k) for k in np.unique(pairs[1]).tolist()}
    shift = np.fromiter((zlib.crc32(zeros[k], zlib.crc32(prefix[d])) ^ zlib.crc32(zeros[k]) for d, k in pairs.T.tolist()), np.uint32, pairs.shape[1])
    h = of_word[index] ^ shift[back.ravel()]
    hit = np.flatnonzero(h % every == 0)
    n -= np.bincount(index[hit], minlength=len(words))
    cut = [_without(w, k) for w, k in zip(words.take(pa.array(index[hit])).to_pylist(), (h[hit].astype(np.int64) % length[hit]).tolist())]
    return pa.concat_tables([pa.table({"word": words.cast(pa.string()), "n": n}), pa.table({"word": pa.array(cut, pa.string()), "n": np.ones(len(cut), np.int64)})])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, every: int = 0, held: int = 1 << 20) -> DataFrame:
    """(word, n) of the runs of at least `least` letters in all documents.

    every: of each document, runs whose CRC32 of `<id>:<run>` it divides lose the letter at CRC modulo length, and count as the rest.
    A task holds the counts of about `held` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def summed() -> pa.Table:
            t = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")])
            return t.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in pieces(batches, "text", 8 << 20):
            t = _counted(batch.column("id"), batch.column("text"), least, every)
            kept.append(t.filter(pc.and_(pc.greater(t["n"], 0), pc.greater_equal(pc.utf8_length(t["word"]), least))))
            if sum(x.num_rows for x in kept) > held:
                kept = [summed()]
                if kept[0].num_rows > held // 2:
                    yield from kept[0].to_batches(max_chunksize=1 << 16)
                    kept = []
        if kept:
            yield from summed().to_batches(max_chunksize=1 << 16)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _lists(words: DataFrame, n_words: int, shard_words: int, shard_letters: int) -> DataFrame:
    """(first, n_words, letters, words, counts): sorted lists of ranges of words, each within the bounds, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [pa.array(held[:1], pa.string()), pa.array([len(held)]), pa.array([letters]), pa.array(["\n".join(held)], pa.string()), pa.array([np.array(count, np.int64).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["first", "n_words", "letters", "words", "counts"])

        held, count, letters = [], [], 0
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if held and (len(held) == shard_words or letters + len(w) > shard_letters):
                    yield made()
                    held, count, letters = [], [], 0
                held.append(w)
                count.append(n)
                letters += len(w)
        if held:
            yield made()

    parts = max(1, math.ceil(n_words / (0.8 * shard_words)))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "first string, n_words long, letters long, words string, counts binary")


def _tries(words: DataFrame, n_words: int, shard_words: int, shard_letters: int) -> Iterator[trie.Trie]:
    """Tries of consecutive ranges of words, each within the bounds; one at a time is on the driver."""
    lists = stored(_lists(words, n_words, shard_words, shard_letters), "spelling-lists")
    shards: list[list] = []
    for r in lists.select("first", "n_words", "letters").orderBy("first").collect():
        if shards and shards[-1][2] + r["n_words"] <= shard_words and shards[-1][3] + r["letters"] <= shard_letters:
            shards[-1] = [shards[-1][0], r["first"], shards[-1][2] + r["n_words"], shards[-1][3] + r["letters"]]
        else:
            shards.append([r["first"], r["first"], r["n_words"], r["letters"]])
    for lo, hi, *_ in shards:
        some = lists.filter(F.col("first").between(lo, hi)).orderBy("first").collect()
        yield trie.build([w for r in some for w in r["words"].split("\n")], np.concatenate([np.frombuffer(r["counts"], np.int64) for r in some]))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, shard_letters: int = SHARD_LETTERS, a_task: int = 1 << 14) -> DataFrame:
    """(word, n_near, form_n, form): of each word with neighbours their number and the commonest; words: word, n, distinct, stored.

    One pass over the words for each trie; a row a word and trie comes out of it.
    """
    spark = words.sparkSession
    n_words = words.count()
    tasks = max(1, math.ceil(n_words / a_task))

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = trie.Trie.loads(shared.value)
            for batch in batches:
                own = batch.column("word").to_pylist()
                row, near = trie.neighbours(t, *trie.encode(own))
                n = np.bincount(row, minlength=len(own))
                best = np.lexsort((near, -t.count[near], row))
                row, near = row[best], near[best]
                top = np.flatnonzero(np.diff(row, prepend=-1))
                row, near = row[top], near[top]
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(row)), pa.array(n[row].astype(np.int64)), pa.array(t.count[near]), pa.array(t.words(near), pa.string())], names=["word", "n_near", "form_n", "form"])

        return run

    schema, path = "word string, n_near long, form_n long, form string", shared_dir(spark, "spelling-near")
    dealt = words.select("word").repartition(tasks, "word")
    for t in _tries(words, n_words, shard_words, shard_letters):
        shared = spark.sparkContext.broadcast(t.dumps())
        dealt.mapInArrow(against(shared), schema).write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(schema).parquet(path) if n_words else spark.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame, broadcast_rows: int, max_rounds: int = 64) -> DataFrame:
    """(word, root): word's last form; forms: word, form. n at least doubles along forms, so they end; each round doubles the steps."""
    at, last = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots"), None
    for _ in range(max_rounds):
        step = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        path = shared_dir(at.sparkSession, "spelling-roots")
        at.join(small(step, broadcast_rows), F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(path)
        now = at.sparkSession.read.parquet(path)
        if last:
            drop_dir(at.sparkSession, last)
        last, at = path, now.select("word", "root")
        if now.filter("moved").isEmpty():
            return at
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_n: int = 3, ratio: int = 2, every: int = 0,
             shard_words: int = SHARD_WORDS, shard_letters: int = SHARD_LETTERS, broadcast_rows: int = 500_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least least_letters letters and least_n occurrences.

    form: the commonest neighbour, if it has at least ratio times the occurrences. `every`: as in word_counts.
    """
    words = stored(word_counts(docs, id_col, text_col, least_letters, every).filter(F.col("n") >= least_n), "spelling-words")
    near = near_words(words, shard_words, shard_letters)
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[
        F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")])
    all_words = stored(joined, "spelling-forms")
    roots = _roots(all_words.filter("form IS NOT NULL"), broadcast_rows)
    return all_words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
