"""Registered queries against their reference SQL on the smallest data set.

Most clustering queries are left to check.py, which runs all queries.
"""

import os

import duckdb
import pytest

from check import TABLES, normal
from shelfglass.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = [n for n in QUERIES if n in ORACLES and n.split("_")[0] in {
    "P03", "P05", "P08", "P10", "P18", "A06", "A08", "A12", "A15", "A18", "A21", "A22", "J02", "J05", "J07", "J09",
    "W01", "W03", "R02", "R06", "S01", "S08", "S10", "S11", "X01", "X04", "X06", "X18", "F04", "F06", "F09", "F13",
    "U03", "U06", "U10", "U12", "U14", "U19", "U22", "U24", "U27", "U28", "U29", "X08", "X13"}]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_reference_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cur.fetchall())


def test_every_reference_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
