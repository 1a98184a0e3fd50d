import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda df: sorted(str([None if x != x or x is None else float(x) if isinstance(x, (int, float)) else str(x) for x in row]) for row in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist())
    assert shown(got) == shown(want)
