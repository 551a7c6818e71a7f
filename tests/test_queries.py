"""Every registered query with its SQL on the smallest tables; shapes must agree in full."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

from promoforge.plans.driver import all_oracles, all_queries  # noqa: E402

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="tables not available")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 21
