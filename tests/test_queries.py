"""Every query of the catalog against its SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from agentmeter.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "events documents benchmark pages conversations"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


#: Queries that SQL cannot express: their own tests hold them against brute force.
NO_SQL = {"c17_figures"}


def test_only_those_named_have_no_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == NO_SQL


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    got = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    theirs = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert mine == theirs
