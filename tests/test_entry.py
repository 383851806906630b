import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recordlens.suite import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    return str(list(v)) if isinstance(v, (list, tuple)) else str(float(v)) if isinstance(v, float) else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries()) and set(all_oracles()) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(entry.oracle_sql()[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())
