"""The driver contract, and every query outside the training-data operators against its SQL."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
EVERY = sorted(entry._core.SQL)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["assign_sequential"]


@pytest.mark.parametrize("name", EVERY)
def test_rows_equal_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF).select(*q.columns)
    near = lambda v: float(f"{float(v):.9g}") if isinstance(v, (float, decimal.Decimal)) else v
    key = lambda rows: sorted((tuple(near(v) for v in r) for r in rows), key=repr)
    assert key(df.collect()) == key(q.fetchall())
