"""Every registered query against its SQL twin on the smallest data."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_a_twin_of_the_same_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    if name in entry.oracle_sql():
        assert compare(got, con.sql(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "reading_order" in df.columns
