"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. A stage's result is written as Parquet and read again before the next one. SQL can express neither the
first stage nor those behind it, so there is no ORACLE_SQL; tests compare every stage with a plain version on its own input.

In all stages columns besides those of documents are dropped, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoprev.llm import decontaminate, language_id, mixing, simhash, token_store
from geoprev.llm.queries import word_tokenizer
from geoprev.llm.util import small, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose language is less sure than this is rejected.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is sure; the model learns from a bounded sample of labelled ones.

    Null and empty texts and texts without a letter are rejected, and so are all documents if no lang is given anywhere. Ties
    between languages have a sureness of a half, which is enough. Every row is judged on its own text; repeated rows stay.
    """
    docs = docs.select(COLUMNS)
    model = language_id.language_model(docs)
    kept = language_id.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8, checked) one row: of the least doc_id.

    A row is known by its doc_id (null counts as one) and the hash of its text; of rows equal in both one stays, the least
    in the order of all columns. Null counts as empty text; texts without words are near-duplicates of each other.
    """
    docs = docs.select(COLUMNS).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = simhash.near_duplicates(docs.select(F.struct("doc_id", "th").alias("key"), "text"), shingle=5, id_col="key", similarity=0.8)
    first = stored(groups.filter("doc_id <=> component_id").groupBy("doc_id").count().select(
        F.col("doc_id.doc_id").alias("of"), F.col("doc_id.th").alias("of_th"), "count"), "near-dedup-first")
    kept = docs.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    once = kept.filter("count = 1").select(COLUMNS)
    again = kept.filter("count > 1").groupBy("of", "of_th").agg(F.min(F.struct(COLUMNS)).alias("one"))
    return once if first.filter("count > 1").isEmpty() else once.unionByName(again.select("one.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows of 13 words cover at least a twentieth; a text is known by its hash.

    Null and empty texts have no words and stay; repeated rows go or stay together; items without an id count too.
    """
    docs = docs.select(COLUMNS).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.contamination(docs.select(F.col("th").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stored(found.filter(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("th")).distinct(), "contaminated")
    return docs.join(small(bad, 1_000_000), "th", "left_anti").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the words of each source come to its target; a copy is a row of its own.

    A null source is a source of its own. Null and empty texts have no words: they are taken where their place in the order of
    their source lies inside the target, and cost nothing. The order is by a hash of all columns; repeated rows count each.
    """
    mixed = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")), carry=["text", "lang", "source", "n_chars"])
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns what is read back: doc_id, start, n_tokens, ids_crc32.

    One row for each document and copy: null and empty texts are the end id alone, a null doc_id comes first, repeated rows
    follow one another.
    """
    path = token_store.write_store(docs.select("doc_id", "text"), word_tokenizer())
    return token_store.checksums(spark, path)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixture),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else stored(out, f"pipeline-{name}")
    return docs
