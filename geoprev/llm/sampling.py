"""A bounded, seeded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import small, stored


def labelled_sample(rows: DataFrame, per_label: int, max_bytes: int, max_labels: int = 256, seed: int = 11) -> dict:
    """At most per_label texts of at most max_bytes each, by label; rows: doc_id, text, label.

    Text and label come from the same row. Labels are the max_labels commonest. Taken are the rows with the least seeded
    hash of doc_id (then of the text), whatever else has the same doc_id; empty and null texts are passed over. Texts fit if
    they have at most max_bytes; where a label has fewer than per_label of them, longer ones make up for it, each by a piece of
    max_bytes / 4 letters from a seeded place, so no label is lost for the length of its texts. A first cut by the hash leaves
    about 2 * per_label rows a label; one job ranks these and sends the least of each label.
    """
    h, size = F.xxhash64(F.lit(seed), "doc_id"), F.octet_length("text")
    rows = rows.filter("label IS NOT NULL AND doc_id IS NOT NULL AND text <> ''").select("label", "text", h.alias("h"), (size > max_bytes).alias("long"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("long").alias("long")).orderBy(F.col("n").desc(), "label").limit(max_labels).collect()
    if not counts:
        return {}
    share, of_long = F.lit(0.0), F.lit(0.0)
    for r in counts:
        fit, here = r["n"] - r["long"], F.col("label") == F.lit(r["label"])
        share = F.when(here, min(1.0, (2 * per_label + 40) / max(1, fit))).otherwise(share)
        of_long = F.when(here, min(1.0, (2 * (per_label - fit) + 40) / max(1, r["long"])) if fit < per_label else 0.0).otherwise(of_long)
    near = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) < F.when(F.col("long"), of_long).otherwise(share))
    letters = max_bytes // 4
    piece = F.substr("text", F.pmod(F.col("h"), F.greatest(F.char_length("text") - letters, F.lit(0)) + 1).cast("int") + 1, F.lit(letters))
    near = stored(near.select("label", F.when(F.col("long"), piece).otherwise(F.col("text")).alias("text"), "long", "h", F.xxhash64(F.lit(seed), "text").alias("t")), "labelled-sample")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("long", "h", "t", "text"))
    got: dict = {}
    for r in near.withColumn("rank", rank).filter(F.col("rank") <= per_label).collect():
        got.setdefault(r["label"], []).append((r["rank"], r["text"]))
    return {k: [t for _, t in sorted(got[k])] for k in sorted(got)}


def label_rows(labels: DataFrame, docs: DataFrame, per_label: int, seed: int = 11, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text, label of documents whose labels are in another table (doc_id, label); the greatest label of a doc_id counts.

    Only ids that the sample can take (by the same hash) meet the texts, by a broadcast if they are few enough.
    """
    one = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = one.groupBy("label").count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("label") == r["label"], min(1.0, (2 * per_label + 40) / r["count"])).otherwise(share)
    picked = stored(one.filter((F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64) + 0.5) < share), "labelled-ids")
    return docs.select("doc_id", "text").join(small(picked, broadcast_rows), "doc_id")
