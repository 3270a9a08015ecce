"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection.

Documents are aggregated by membership pattern (the set of sources they belong to). A small network on the
driver routes each pattern's words to the quotas of its sources; the k-th copy of a pattern costs
k squared, so repetition is spread (convex cost). The flow of a pattern is then turned into documents:
in the order of a seeded hash of all their columns, a copy of a document is taken if the middle of its words lies inside the
flow. The order needs no global sort: words are summed by hash bucket and bucket sums accumulated for each pattern. A bucket that no
limit of a flow falls into is taken or left as a whole, so its rows go nowhere; rows are ordered only inside the few buckets that
hold a limit (one for each limit of a pattern, 1 / BUCKETS of its rows), equal rows as one with their number.

A source with a third of all rows is dealt over all buckets, and so are rows of one identifier; equal rows are summed before they
meet. Patterns are collected to the driver; more than max_patterns raises an error (100,000 patterns of two of 2,000 sources
took the network 5.5 s).

Defined results: a null source is a source of its own, last; null text has size 0; repeated rows count each; reruns agree on every
row and carried column, whatever the partitions (rows equal in all of them can't be told apart); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import small, stored

BUCKETS = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sizes: dict, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target words by source: by weight, none above cap times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), dict.fromkeys(order, 0.0)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, max_copies: int = 2) -> dict[tuple, dict]:
    """Words from each pattern to each of its sources; the k-th copy costs k * k, and as many words as the quotas allow are sent.

    Only the first arc of a path costs anything, so cheapest paths first means: all that first copies can send, then second
    ones, and so on; what was sent before may be routed anew. Each of these is a maximal flow by blocking flows.
    """
    kinds, sources = list(patterns), list(quotas)
    node = {s: 2 + len(kinds) + i for i, s in enumerate(sources)}
    start, end, n = 0, 1, 2 + len(kinds) + len(sources)
    to: list[int] = []
    left: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            arcs[x].append(len(to))
            to.append(y)
            left.append(c)
        return len(to) - 2

    first = [arc(start, 2 + i, 0) for i in range(len(kinds))]
    used = {(p, s): arc(2 + i, node[s], patterns[p] * max_copies) for i, p in enumerate(kinds) for s in p}
    for s, q in quotas.items():
        arc(node[s], end, q)
    for _ in range(max_copies):
        for i, p in enumerate(kinds):
            left[first[i]] += patterns[p]
        while True:
            level, todo = [-1] * n, [start]
            level[start] = 0
            for a in todo:
                for i in arcs[a]:
                    if left[i] > 0 and level[to[i]] < 0:
                        level[to[i]] = level[a] + 1
                        todo.append(to[i])
            if level[end] < 0:
                break
            at, path, here = [0] * n, [], start
            while True:  # a blocking flow: paths along the levels until there is none
                if here == end:
                    f = min(left[i] for i in path)
                    for k, i in enumerate(path):
                        left[i] -= f
                        left[i ^ 1] += f
                    k = next(k for k, i in enumerate(path) if left[i] == 0)
                    here = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[here] < len(arcs[here]) and not (left[i := arcs[here][at[here]]] > 0 and level[to[i]] == level[here] + 1):
                    at[here] += 1
                if at[here] < len(arcs[here]):
                    path.append(i)
                    here = to[i]
                elif here == start:
                    break
                else:
                    level[here] = -1
                    here = to[path.pop() ^ 1]
    return {p: {s: left[used[p, s] ^ 1] for s in p} for p in kinds}


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", quotas=share_targets,
        max_copies: int = 2, seed: int = 7, max_patterns: int = 100_000, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, sources, size, pattern_size, flow, copies, taken, routes array<struct<source, words>>).

    sources: array of a document's sources; quotas: words by source from the words of all its documents.
    """
    if clash := {"doc_id", "sources", "size", "pattern_size", "flow", "copies", "taken", "routes", "h", "bucket", "at", "base", "mids", "n", "cut", "middle", "m", "j"}.intersection(carry or []):
        raise ValueError(f"columns of these names can't be carried: {sorted(clash)}")
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("sources"),
                              size.alias("size"), *[F.col(f"`{c}`") for c in carry or []]), "mix-sizes")
    sums = rows.groupBy("sources").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["sources"]): int(r["n"] or 0) for r in sums}
    by_source: dict = {}
    for p, n in patterns.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    targets = quotas(by_source)
    flows = min_cost_flow(patterns, {s: round(q) for s, q in targets.items()}, max_copies)
    spark = docs.sparkSession
    kind = rows.schema["sources"].dataType.simpleString()
    plan = spark.createDataFrame(
        [(list(p), patterns[p], sum(f.values()), [(s, sum(list(f.values())[:i]), sum(list(f.values())[: i + 1])) for i, s in enumerate(f)]) for p, f in flows.items()],
        f"sources {kind}, pattern_size long, flow long, routes array<struct<source: string, lo: long, hi: long>>")
    keep = ["doc_id", "sources", "size", *(carry or [])]
    quoted = [f"`{c}`" for c in keep]
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), *quoted)).withColumn("bucket", F.shiftrightunsigned("h", 64 - int(math.log2(BUCKETS))))
    before = Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sources", "bucket").agg(F.sum("size").alias("n")).select(
        "sources", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(F.broadcast(plan), "sources")
    # a limit of the flow or of a route falls into the bucket, for some copy
    limits = F.concat(F.array("flow"), F.transform("routes", lambda r: r["lo"]), F.transform("routes", lambda r: r["hi"]))
    copies_of = F.sequence(F.lit(0), F.lit(max_copies - 1))
    cut = F.exists(limits, lambda c: F.exists(copies_of, lambda k: (c >= F.col("base") + k * F.col("pattern_size")) & (c <= F.col("base") + F.col("n") + k * F.col("pattern_size"))))
    starts = stored(starts.select("sources", "bucket", "n", "base", "pattern_size", "flow", "routes", cut.alias("cut")), "mix-buckets")
    given = rows.join(small(starts, 500_000), ["sources", "bucket"])
    whole = given.filter("NOT cut").withColumn("middle", F.col("base") + F.col("n") / 2)
    inside = Window.partitionBy("sources", "bucket").orderBy("h", *[F.col(c) for c in quoted]).rowsBetween(Window.unboundedPreceding, -1)
    group = [*quoted, "h", "bucket", "n", "base", "pattern_size", "flow", "routes", "cut"]
    equal = given.filter("cut").groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    placed = equal.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    ordered = placed.withColumn("middle", F.col("base") + F.col("at") + F.col("j") * F.col("size") + F.col("size") / 2).drop("m", "at", "j")
    all_rows = whole.unionByName(ordered)
    mids = F.filter(F.transform(copies_of, lambda k: F.col("middle") + k * F.col("pattern_size")), lambda m: m < F.col("flow"))
    return all_rows.withColumn("mids", mids).select(
        "doc_id", "sources", "size", "pattern_size", "flow", F.size("mids").alias("copies"), (F.size("mids") * F.col("size")).cast("long").alias("taken"),
        F.transform("routes", lambda r: F.struct(r["source"].alias("source"), (
            F.size(F.filter("mids", lambda m: (m >= r["lo"]) & (m < r["hi"]))) * F.col("size")).cast("long").alias("words"))).alias("routes"),
        *[F.col(f"`{c}`") for c in carry or []])


def source_targets(spark, sizes: dict) -> DataFrame:
    t = share_targets(sizes)
    return spark.createDataFrame([(s, sizes[s], float(t[s])) for s in t], "source string, source_size long, target double")
