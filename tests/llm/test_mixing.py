import re

import pytest
from pyspark.sql import functions as F

from geoprev.llm import mixing as M
from geoprev.llm import queries


def test_targets():
    t = M.share_targets({"a": 100, "b": 100, None: 1000})
    assert list(t) == ["a", "b", None]
    assert t["a"] == 200 and t["b"] == 200 and t[None] == pytest.approx(1400)  # both are capped, the rest goes on
    assert M.share_targets({"a": 0, "b": 10})["b"] == pytest.approx(15)
    assert M.share_targets({}) == {}


def test_flow_takes_copies_only_where_it_must():
    flows = M.min_cost_flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 60})
    assert sum(flows[("a",)].values()) + flows[("a", "b")]["a"] == 150
    assert flows[("a", "b")]["b"] + flows[("b",)]["b"] == 60
    assert sum(flows[("a", "b")].values()) <= 100 and flows[("a",)]["a"] <= 100  # 210 words suffice once
    assert sum(M.min_cost_flow({("a",): 10}, {"a": 99})[("a",)].values()) == 20


def test_query_on_brute_force(spark, sf_dir):
    rows = queries.op7_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = {i: len(re.findall("[^\x20\x09-\x0d]+", d.text or "")) for i, d in docs.items()}
    total: dict = {}
    for i, d in docs.items():
        total[d.source] = total.get(d.source, 0) + sizes[i]
    targets = M.share_targets(total)
    assert len(rows) == len(docs)
    taken: dict = {}
    for r in rows:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (sizes[r.doc_id], total[s], pytest.approx(targets[s]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    longest = {s: max(sizes[i] for i, d in docs.items() if d.source == s) for s in total}
    assert all(abs(taken[s] - targets[s]) <= longest[s] + 1 for s in total)
    assert sorted(map(tuple, queries.op7_mixing(spark, sf_dir).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_overlapping_sources_and_edges(spark, edge, empty):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit(None).cast("string"))).alias("of"))
    out = M.mix(docs, F.col("of"), F.lit(10).cast("long"), quotas=lambda s: {"a": 2000, "b": 1000, None: 500})
    by = out.select(F.explode("routes").alias("r")).groupBy("r.source").agg(F.sum("r.words").alias("n")).collect()
    got = {r.source: r.n for r in by}
    assert abs(got["a"] - 2000) <= 20 and abs(got["b"] - 1000) <= 20 and abs(got[None] - 500) <= 20
    assert out.count() == 500 and out.filter("taken > 20").count() == 0
    e = M.mix(edge, F.array("source"), M.word_count(F.col("text")))
    assert e.count() == edge.count() and {r.doc_id: r["size"] for r in e.collect()}[6] == 60_001
    assert M.mix(empty, F.array("source"), M.word_count(F.col("text"))).count() == 0
    with pytest.raises(ValueError, match="carried"):
        M.mix(edge, F.array("source"), F.lit(1), carry=["size"])


def cheapest(patterns, quotas, copies):
    """The same network one word and one cheapest path at a time."""
    flow, first = {p: dict.fromkeys(p, 0) for p in patterns}, dict.fromkeys(patterns, 0)
    sent, cost = dict.fromkeys(quotas, 0), 0
    while True:
        for price, p0 in sorted(((first[p] // w + 1) ** 2, p) for p, w in patterns.items() if w and first[p] < copies * w):
            via, todo, end = {}, [("p", p0)], None
            for kind, x in todo:
                if kind == "s" and sent[x] < quotas[x]:
                    end = x
                    break
                for y in ([("s", s) for s in x] if kind == "p" else [("p", p) for p in patterns if flow[p].get(x, 0) > 0]):
                    if y not in via and y != ("p", p0):
                        via[y] = (kind, x)
                        todo.append(y)
            if end is not None:
                break
        else:
            return sum(sent.values()), cost
        at, first[p0], cost = ("s", end), first[p0] + 1, cost + price
        sent[end] += 1
        while at != ("p", p0):
            was = via[at]
            if at[0] == "s":
                flow[was[1]][at[1]] += 1
            else:
                flow[at[1]][was[1]] -= 1
            at = was


def test_flow_is_largest_and_cheapest():
    import random

    r = random.Random(8)
    for _ in range(40):
        sources = "abcd"[: r.randint(1, 4)]
        patterns = {tuple(sorted(r.sample(sources, r.randint(1, len(sources))))): r.randint(0, 6) for _ in range(r.randint(1, 6))}
        quotas = {s: r.randint(0, 9) for s in sources}
        flows = M.min_cost_flow(patterns, quotas)
        words = {p: sum(f.values()) for p, f in flows.items()}
        assert all(sum(f.get(s, 0) for f in flows.values()) <= q for s, q in quotas.items())
        assert all(0 <= words[p] <= 2 * w for p, w in patterns.items())
        cost = sum(min(words[p], w) + 4 * max(0, words[p] - w) for p, w in patterns.items())
        assert (sum(words.values()), cost) == cheapest(patterns, quotas, 2)


def test_many_patterns_take_seconds():
    import time

    began = time.perf_counter()
    M.min_cost_flow({tuple(sorted((f"s{i % 300}", f"s{i * 7 % 299}"))): 50 + i % 13 for i in range(4000)}, {f"s{i}": 300 + i for i in range(300)})
    assert time.perf_counter() - began < 30


def test_equal_identifiers_and_rows(spark):
    """Rows of one identifier and size with other texts, and rows equal in all columns: the same copies whatever the partitions; no bucket holds a third."""
    rows = [(7, f"text {i} x", "s", "a") for i in range(2000)] + [(None, None, "s", "a")] * 500 + [(9, "the same words", "s", "a")] * 700 + [(i, "w " * (i % 50), "t", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    quotas = lambda sizes: {"s": 0.75 * sizes["s"], "t": 1.4 * sizes["t"]}
    mixed = lambda n: M.mix(docs.repartition(n, "text"), F.array("source"), M.word_count(F.col("text")), quotas=quotas, carry=["text", "source", "lang"])
    one, other = (sorted(((r.doc_id, r.text, r.copies) for r in mixed(n).collect()), key=repr) for n in (4, 7))
    assert one == other and len(one) == len(rows)
    taken = {"s": 0, "t": 0}
    for r in mixed(3).collect():
        taken[r.source] += r.taken
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in "st"}
    assert abs(taken["s"] - 0.75 * sizes["s"]) <= 4 and abs(taken["t"] - 1.4 * sizes["t"]) <= 50


def test_texts_stay_where_they_are(spark):
    """Only rows of buckets with a limit are shuffled with their texts."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    out = M.mix(docs, F.array("source"), M.word_count(F.col("text")), carry=["text", "source"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "cut" in plan
    assert out.count() == 20_000
