"""Every registered query against its SQL, or against its schema where SQL cannot express it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from multifactor.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in registry.oracle_sql():
        columns = ", ".join(f'"{c}"' for c in df.columns)
        want = sorted(con.execute(f"select {columns} from ({registry.oracle_sql()[name]})").fetchall(), key=repr)
        assert rows == want


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 70
