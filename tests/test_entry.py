"""The driver's contract holds, with or without the optional subpackage."""

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "sig_dividend_low_vol" in queries and set(sql) <= set(queries)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["signal_date", "ts_code", "weight", "score", "place"] and df.count() > 0
