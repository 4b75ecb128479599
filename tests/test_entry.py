"""The entry module's contract."""

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "downside_breadth" in df.columns
