"""Driver contract: entry, queries and oracles; oracle agreement on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert {"price_bin", "listings", "is_gap"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


FAST_KEYS = ["ag_10", "ag_11", "ag_02", "ag_13", "ag_29", "ag_30", "w_01", "w_02", "w_03",
             "fe_05", "cln_21", "j_04", "ag_41", "ag_08"]


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_agreement(spark, duck, key):
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]
