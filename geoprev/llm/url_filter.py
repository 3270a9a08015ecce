"""URL filters by a temporal list join.

A list is a table of dated events (pattern, action, since, seq, category): from that day on the pattern is under that
action, `block` or `allow`, or `off` it. Events of a pattern become validity intervals. A pattern is a host with all its
subdomains, and may go on with a path; a capture meets the patterns that are suffixes of its host with leading parts of
its path, and is judged by the entries active when it was fetched: the most specific one (longest host, then longest
path) decides.

The join is on the pattern, with the interval as a further condition; captures carry one row for each pattern they could
meet, and a host with a third of all captures is a hot key of that join: lists are broadcast as long as their size is
below a bound, beyond it adaptive execution splits the sort-merge join. Verdicts are combined before the shuffle.

Defined results: a null or host-less URL or a null day meets no entry and is not blocked; of events of one pattern on
one day the greatest seq holds; repeated rows get equal verdicts; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import small, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without port, user and a closing dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(events: DataFrame) -> DataFrame:
    """pattern, action, category, since, until (null: still valid) of the stretches in which a pattern is on."""
    days = events.groupBy("pattern", "since").agg(F.max_by(F.struct("action", "category"), "seq").alias("e"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return days.select("pattern", "e.action", "e.category", "since", until.alias("until")).filter("action <> 'off'")


def patterns(host: Column, path: Column, depth: int) -> Column:
    """Suffixes of the host, each also with up to depth leading parts of the path; the most specific first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    most = F.least(F.size(parts), F.lit(depth))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.sequence(most, F.lit(0), F.lit(-1)), lambda k: F.concat(s, F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))))))


def judge(captures: DataFrame, events: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """Every capture (page_id, url, day) with host, blocked, and the pattern and category that decided."""
    valid = stored(intervals(events), "url-intervals")
    depth = valid.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    rows = captures.select("page_id", "url", "day").withColumn("host", url_host(F.col("url")))
    met = rows.filter("host IS NOT NULL AND day IS NOT NULL").distinct().select(
        "page_id", "url", "day", F.posexplode(patterns(F.col("host"), url_path(F.col("url")), depth)).alias("rank", "pattern"))
    active = met.join(small(valid, broadcast_rows), "pattern").filter("day >= since AND (until IS NULL OR day < until)")
    verdict = active.groupBy("page_id", "url", "day").agg(F.min_by(F.struct("pattern", "action", "category"), "rank").alias("e"))
    verdict = verdict.toDF("of_page", "of_url", "of_day", "e")
    same = F.col("page_id").eqNullSafe(F.col("of_page")) & F.col("url").eqNullSafe(F.col("of_url")) & F.col("day").eqNullSafe(F.col("of_day"))
    return rows.join(verdict, same, "left").select(
        "page_id", "url", "day", "host", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"), F.col("e.pattern").alias("pattern"), F.col("e.category").alias("category"))
