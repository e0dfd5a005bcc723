"""Every query with an oracle, against DuckDB on the smallest driver tables."""

from __spark_entry__ import oracle_sql

from tests.oracle_compare import compare


def test_all_oracle_queries_match(spark):
    names = sorted(oracle_sql())
    res = compare(spark, "/root/testdata/sf0.001", names, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad
