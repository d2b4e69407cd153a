"""Every catalogue query against the same in SQL on the smallest tables."""

import math
import os

import pytest

from pulselake.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("-" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    if name in catalogue.ORACLE:
        res = con.execute(catalogue.ORACLE[name])
        at = [[d[0] for d in res.description].index(c) for c in cols]
        assert got == plain(tuple(r[i] for i in at) for r in res.fetchall())


def test_entry_lists_what_is_there():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
