"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skein.plans import registry


def _norm(rows, columns):
    def value(x):
        if isinstance(x, float):
            return round(x, 6)
        return str(x) if x.__class__.__name__ == "Decimal" else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert df.columns
        return
    q = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    assert _norm(rows, df.columns) == _norm(q.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
