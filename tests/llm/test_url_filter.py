from datetime import date

from pyspark.sql import functions as F

from geoprev.llm import url_filter as U

EVENTS = "pattern string, action string, since date, seq int, category string"
CAPTURES = "page_id long, url string, day date, host string, blocked string"


def test_verdicts_follow_the_list_of_the_day(spark):
    d = lambda m, k=1: date(2024, m, k)
    events = spark.createDataFrame([
        ("bad.org", "block", d(3), 1, "c"), ("bad.org", "off", d(6), 1, "c"), ("good.bad.org", "allow", d(4), 1, "r"),
        ("x.org/a/b", "block", d(1), 1, "p"), ("x.org", "allow", d(1), 1, "q"), ("y.org", "block", d(2), 1, "a"), ("y.org", "off", d(2), 2, "a")], EVENTS)
    rows = [(1, "http://bad.org/", d(2), False), (2, "http://bad.org/", d(3), True), (3, "https://WWW.Bad.org:80/x?y", d(5, 31), True), (4, "http://bad.org", d(6), False),
            (5, "http://good.bad.org/", d(3, 9), True), (6, "http://good.bad.org/", d(4), False), (7, "http://notbad.org/", d(4), False),
            (8, "http://x.org/a/b/c", d(5), True), (9, "http://x.org/a/bc", d(5), False), (10, "http://u@x.org//a//b", d(5), True), (11, "http://y.org/", d(2), False),
            (12, None, d(4), False), (13, "no url", d(4), False), (14, "http://bad.org/", None, False), (2, "http://bad.org/", d(3), True)]
    caps = spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], CAPTURES)
    for broadcast in (500_000, 0):
        got = [(r.page_id, r.blocked) for r in U.judge(caps, events, broadcast).collect()]
        assert sorted(got) == sorted((r[0], r[3]) for r in rows)
    assert {r.blocked for r in U.judge(caps, events.limit(0)).collect()} == {False}
    assert U.judge(caps.limit(0), events).count() == 0


def test_patterns_are_the_most_specific_first(spark):
    got = spark.range(1).select(U.patterns(F.lit("a.b.c"), F.lit("/x/y/"), 1).alias("p")).first().p
    assert got == ["a.b.c/x", "a.b.c", "b.c/x", "b.c", "c/x", "c"]


def test_very_long_urls(spark):
    """A million letters of path, a deep path under a listed one, and a host of many labels."""
    d = date(2024, 5, 1)
    events = spark.createDataFrame([("bad.org", "block", d, 1, "c"), ("x.org/a", "block", d, 1, "p")], EVENTS)
    rows = [(1, "http://bad.org/" + "p" * 1_000_000, True), (2, "http://x.org/a/" + "b/" * 2000, True), (3, "http://x.org/ab" + "b/" * 2000, False), (4, "http://" + "s." * 60 + "bad.org/", True), (5, "http://good.org/?" + "q=1&" * 100_000, False)]
    caps = spark.createDataFrame([(i, u, d, "clash", "clash") for i, u, _ in rows], CAPTURES)
    assert sorted((r.page_id, r.blocked) for r in U.judge(caps, events).collect()) == [(i, b) for i, _, b in rows]
