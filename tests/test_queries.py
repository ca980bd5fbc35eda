"""Every registered query of the analytics operators against its DuckDB SQL, and the entry contract."""

import pytest

import __spark_entry__ as entry
from helpers import same
from playsight.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_is_repeatable(spark, sf, name):
    one, two = (sorted(map(str, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert one and one == two


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["l_suppkey", "region", "value", "percentile"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
