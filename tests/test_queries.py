"""Every registered query runs on the smallest tables; those with SQL are held against DuckDB there."""

import math
import os

import pytest

from voxelwave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def _rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            if v is None or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif hasattr(v, "item"):
                row.append(v.item())
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
