"""Every named query against its SQL statement on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

from check import TABLES, compare
from splicelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    msg, _ = compare(spark, con, name, SF)
    assert msg.startswith("ok" if name in ORACLES else "ROWS"), msg


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
