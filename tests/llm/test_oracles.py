"""Queries with SQL equal it; every operator has a query."""

import re

import pytest

from almagest.llm import queries
from almagest.plans import harness


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, duck, sf_dir, name):
    r = harness.compare(spark, duck, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert r["ok"], r


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
