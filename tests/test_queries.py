import pytest

from barloom import queries as Q
from barloom import service_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, same, name):
    same(Q.QUERIES[name](spark, data), duck.sql(Q.ORACLE_SQL[name]))


def test_every_sql_has_a_query():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_scan_reaches_the_file(spark, data):
    plan = Q.QUERIES["range_scan_halfopen"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_closed_gate_drops_open_bars(spark, data):
    assert Q.QUERIES["stream_closed_gate"](spark, data).filter("not is_closed").count() == 0
