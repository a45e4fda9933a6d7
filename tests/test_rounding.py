"""Values that lie half way between two roundings agree with SQL."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelwave.plans import registry
from voxelwave.plans.tensor_queries import m6


def test_pieces_with_residuals_half_way(spark, tmp_path):
    """The last pieces are 32 values and the same backwards: no slope, and residuals that are odd multiples of 1/3200.

    The seeds are those whose rounded residuals do not hang on the last bit of the slope, which an engine may sum up in any order.
    """
    duckdb = pytest.importorskip("duckdb")
    rows, start = [], datetime.datetime(2024, 1, 1)
    for u in (44, 94, 155, 292, 312, 373, 386):
        half = [(i * i * 7919 + i * 104729 + u * 15485863) % 56021 for i in range(32)]
        half[0] += 1 - sum(half) % 2
        assert sum(half) % 2 == 1
        y = [(i * 613 + u * 71) % 30011 for i in range(45)] + half + half[::-1]
        rows += [(len(rows) + i, start + datetime.timedelta(seconds=i), u, v / 100) for i, v in enumerate(y)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(u, t): v for u, t, v in c.sql("SELECT user_id, t, value FROM (" + registry.oracle_sql()["detrend_pieces"] + ")").fetchall()}
    got = {(r.user_id, r.t): r.value for r in registry.queries()["detrend_pieces"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) == 7 * 109
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_rounding_as_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(5)
    half = (r.integers(-(10**9), 10**9, 2000) * 2 + 1) / 2e6
    x = np.concatenate([half, np.nextafter(half, 9e9), np.nextafter(half, -9e9), [0.0, -0.0, 5e-7, -5e-7, 0.49999999999999994e-6, 1e305, -1e305, np.inf, np.nan]])
    got = [v.x for v in spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").select(m6(F.col("x")).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0", [float(v)]).fetchall()[0][0] for v in x] + [None]
    assert [str(v) for v in got] == [str(v) for v in want]
