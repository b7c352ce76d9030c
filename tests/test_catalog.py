"""Every catalog query against its DuckDB oracle, and against itself with the input dealt out otherwise."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarrystone.plans import catalog

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.execute(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in r.description], r.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
