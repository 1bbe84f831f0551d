"""Every registered query of the analysis against its SQL, on the smallest tables."""

import datetime
import os

import pytest

from grantscope.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


def plain(value):
    return round(value, 6) if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.date) else value


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    got = sorted(str([plain(x) for x in r]) for r in df.collect())
    assert got == sorted(str([plain(row[k]) for k in order]) for row in want.fetchall()) and got
