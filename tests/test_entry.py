"""The driver's contract, and every oracle against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from kelpline.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_contract():
    assert set(ORACLE_SQL) == set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    mine = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
    assert mine == sorted([tuple(map(plain, r)) for r in want.fetchall()], key=str)
