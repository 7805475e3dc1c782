"""Every query with SQL against DuckDB on the smallest tables; the training-data queries have tests of their own."""

import os

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        expected = want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall()
        assert sorted(map(repr, rows)) == sorted(map(repr, expected))
