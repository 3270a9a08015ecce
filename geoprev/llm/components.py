"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back to the links, so a hub with many
neighbours is no window and no collected list. Each round is written to the shared folder, which cuts the
lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import drop_dir, shared_dir


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in links (a, b); label is the least node reachable. Nulls and loops are ignored."""
    spark = links.sparkSession

    def round_of(df: DataFrame, last: str | None) -> tuple[DataFrame, str]:
        """Write a round, read it back and drop the one before."""
        path = shared_dir(spark, "components")
        df.write.parquet(path)
        if last:
            drop_dir(spark, last)
        return spark.read.schema(df.schema).parquet(path), path

    edges, path = round_of(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a <> b").distinct(), None)
    sign = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select("v", "v")).distinct()
        sign = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lower.hint("merge"), "u")
        edges, path = round_of(star.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(lower.select("u", "m")).distinct(), path)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
