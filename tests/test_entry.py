"""The registered queries: every oracle names a query, the flagship runs, plans stay lean."""

import __spark_entry__ as entry


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_reads_only_its_columns(spark, sf):
    df = entry.queries()["lagged_order_features"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and plan.count("Exchange hashpartitioning") == 1
