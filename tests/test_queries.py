"""Every query of the library runs; those with SQL give what DuckDB gives."""

import pytest
from conftest import SF

from skeinwork import registry

SQL = registry.oracle_sql()
OTHER = sorted(set(registry.queries()) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, same_rows):
    same_rows(registry.queries()[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", OTHER)
def test_gives_rows(name, spark):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_pushdown_reaches_the_scan(spark):
    plan = registry.queries()["index_scan"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
