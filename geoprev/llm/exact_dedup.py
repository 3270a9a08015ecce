"""Exact dedup: stateful streaming deduplication with disk-backed keyed state.

One Structured Streaming query reads the files of the input. Its keyed state lives in RocksDB,
never expires, and holds for each digest the stable identifier and the content locator
(file, row index) of the row that stays, and the size of the group. The state is read back with
the `statestore` source. Every hit (a row whose digest was seen more than once) is checked on
full bytes: texts are fetched by locator and the least and the greatest text of a digest must be
equal. Texts that merely collide on the digest are grouped anew by their bytes.

Skew: the state keeps one row a digest and both aggregations combine before the shuffle, so a group
with a third of all rows sends one row a task. The join that assigns rows to groups carries no texts
and is a sort-merge join that adaptive execution can split.

Defined results: null text counts as empty; ties on the identifier go to the greatest locator, so
exactly one row of a group stays; a null identifier is below all others; an empty table gives no
rows; columns other than the identifier and the text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import ascii_lower, drop_dir, shared_dir, small, stored

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def _keyed(df: DataFrame, id_col: str, text_col: str, digest: str) -> DataFrame:
    norm = ascii_lower(F.col(f"`{text_col}`"))
    # the digest expression is an SQL template so that tests can weaken it
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", F.expr(digest.format("norm")))


def escaped(path: str) -> str:
    """A path as a pattern that matches only it."""
    return re.sub(r"([{}\[\]*?])", r"\\\1", path.rstrip("/"))


def dedup_state(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: str = "sha2({}, 256)") -> DataFrame:
    """Run the stream until all present files are in the state; (digest, keep, group_size) read from the state.

    Run again with the same checkpoint it takes only files that are new.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        path = escaped(path)
        # as a pattern, the path may also be a single file
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path)
        state = _keyed(stream, id_col, text_col, digest).groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.format("statestore").load(checkpoint)
    keep, size = rows.schema["value"].dataType.names[:2]
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{size}`").alias("group_size"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest: str = "sha2({}, 256)", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of the parquet table at path."""
    checkpoint = shared_dir(spark, "exact-dedup-state")
    state = dedup_state(spark, path, checkpoint, id_col, text_col, digest)
    docs = _keyed(spark.read.parquet(escaped(path)), id_col, text_col, digest)
    rows = stored(
        docs.drop("norm").join(state.hint("merge"), "digest").select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
            "digest", "file", "row"),
        "exact-dedup-rows")
    drop_dir(spark, checkpoint)
    # a file is known by a hash here: 16 bytes a hit; if two files had one hash, some rows more would be compared
    hits = small(rows.filter("group_size > 1").select(F.xxhash64("file").alias("of"), "row"), broadcast_rows)
    same = (docs.select("digest", "norm", F.xxhash64("file").alias("of"), "row").join(hits, ["of", "row"])
            .groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")))
    collided = stored(same.filter("lo <> hi").select("digest"), "exact-dedup-collided")
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    if collided.isEmpty():
        return rows.select(out)
    again = docs.join(collided, "digest", "left_semi")
    groups = again.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    redone = again.join(groups.hint("merge"), ["digest", "norm"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))).alias("kept"), "digest")
    return rows.join(collided, "digest", "left_anti").select(out).unionByName(redone)
