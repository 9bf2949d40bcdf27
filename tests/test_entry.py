import __spark_entry__ as entry


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"ep1_orders", "preceding_timed", "written_back"} <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["property", "param1", "param2", "idx", "t", "value"] and rows.count() > 0
