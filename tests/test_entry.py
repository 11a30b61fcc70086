import importlib


def test_entry_has_queries(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
