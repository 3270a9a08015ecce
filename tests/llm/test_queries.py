"""Every query that SQL can express, against DuckDB."""

import pytest

from geoprev.llm import queries
from oracle import assert_same, connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLE[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
