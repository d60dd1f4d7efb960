"""Every registered query against its SQL on the smallest test data."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def rows(columns, names, data):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert rows(columns, df.columns, df.collect()) == rows(columns, rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
