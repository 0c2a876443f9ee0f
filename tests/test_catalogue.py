"""Every registered query of the archive against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(columns, rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(df.columns, rows) == canonical(want.columns, want.fetchall())
    else:
        assert rows


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 2
