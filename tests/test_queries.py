"""Every registered query of the library's own operators against its SQL in another engine."""

import math
from decimal import Decimal

import duckdb
import pytest

from clausemill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        return str(v).lower() if isinstance(v, bool) else str(v)
    return f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, sql, name):
    got = QUERIES[name](spark, sf)
    rel = sql.sql(SQL[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    want = sorted(tuple(map(shown, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
