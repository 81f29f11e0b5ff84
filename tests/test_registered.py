"""Every registered query beside its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries, registered
from registry.compare import compare

ALL = registered()


@pytest.mark.parametrize("key", sorted(ALL))
def test_query_matches_sql(spark, sf, duck, key):
    query, sql = ALL[key]
    ok, note, _ = compare(spark, duck, sf, query, sql)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    out = entry(spark)
    assert out.columns[:2] == ["metric_time__week", "interaction__category_code"]
    assert out.count() > 0
