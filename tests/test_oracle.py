"""Every registered SQL-expressible query equals its DuckDB oracle
(row count, column names, order-insensitive value hash)."""

import pytest

from almagest.plans import harness, registry

ORACLE = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, sf_dir, name):
    r = harness.compare(spark, duck, QUERIES[name], ORACLE[name], sf_dir)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
