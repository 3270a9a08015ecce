import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, digest string"
LONG = "word " * 60_000 + "end"
EDGE = [(1, None), (2, ""), (3, "  \t\n"), (4, "A"), (5, "a"), (6, LONG), (7, LONG.upper()), (8, "one two three four five six"), (8, "one two three four five six"), (9, "One two three four five six"), (None, "no id here"), (10, "!!! 123"), (11, "ÄÖÜ ñandú İ K"), (12, "\x00\x01 <|endoftext|> \x02 x\x02y")]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in EDGE], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def words():
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]

    def make(n, seed):
        q = random.Random(seed)
        return [q.choice(vocabulary) for _ in range(n)]

    return make
