"""Operators that need files, streams or edge cases beyond the driver's tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelwave.functions import columns as C
from voxelwave.functions import dsp
from voxelwave.operators import signal as S
from voxelwave.operators import tensor as T
from voxelwave.sources import codecs, formats
from voxelwave.streaming import filters


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, 60))
    rows = [(c, t, float(x[c, t])) for c in range(2) for t in range(60)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], "channel int, t long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel int, t long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = filters.stream_filter(stream, [0.2, 0.1], [1, -0.5, 0.2]).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.channel, r.t): r.value for r in spark.table("filtered").collect()}
    for c in range(2):
        want, _ = dsp.lfilter([0.2, 0.1], [1, -0.5, 0.2], x[c])
        assert np.allclose([got[c, t] for t in range(60)], want)


def test_files_are_read_by_executors(spark, tmp_path):
    vol = np.arange(24, dtype="f4").reshape(2, 3, 4)
    m = np.diag([2.0, 2, 2, 1])
    (tmp_path / "a.nii.gz").write_bytes(codecs.write_nifti(vol, m, compress=True))
    (tmp_path / "w.nii").write_bytes(codecs.write_warp(np.ones((2, 2, 2, 3)), m))
    (tmp_path / "a.mat").write_bytes(codecs.write_affine(m))
    v = formats.read_nifti(spark, str(tmp_path / "a.nii.gz")).collect()
    assert len(v) == 24 and all(r.value == vol[r.i, r.j, r.k] for r in v)
    assert formats.read_nifti_meta(spark, str(tmp_path / "a.nii.gz")).first().dim == [2, 3, 4]
    assert {(r.dx, r.dy, r.dz) for r in formats.read_warp(spark, str(tmp_path / "w.nii")).collect()} == {(1.0, 1.0, 1.0)}
    assert np.allclose(formats.read_affines(spark, str(tmp_path / "a.mat")).first().m, m.reshape(-1))


@pytest.mark.parametrize("method", T.BASELINE_METHODS)
def test_baseline_guards(spark, method):
    df = spark.createDataFrame([(0, t, 0.0) for t in range(6)] + [(1, t, 3.0) for t in range(6)] + [(2, t, float(t + 1) if t != 4 else None) for t in range(6)], "u int, t int, value double")
    got = {(r.u, r.t): r.value for r in T.baseline(df, ["u"], F.col("t") < 4, method).collect()}
    assert all(got[0, t] == 0 for t in range(6)) and all(abs(got[1, t]) < 1e-9 for t in range(6)) and got[2, 4] is None
    b = np.arange(1.0, 5)
    x = 6.0
    r, lg = np.sqrt(b), np.log10(b)
    want = {"percentage": (x / b.mean() - 1) * 100, "sqrt_percentage": (x**0.5 / r.mean() - 1) * 100, "decibel": 10 * (np.log10(x) - lg.mean()), "zscore": (x - b.mean()) / b.std(ddof=1), "sqrt_zscore": (x**0.5 - r.mean()) / r.std(ddof=1), "db_zscore": (np.log10(x) - lg.mean()) / lg.std(ddof=1), "subtract_mean": x - b.mean()}[method]
    assert abs(got[2, 5] - want) < 1e-9


def test_quantile_rule(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 10)] + [("b", 7.0), ("c", None), ("d", 1.0), ("d", 2.0)], "g string, value double")
    q = lambda p: {r.g: r.value for r in T.quantile(df, ["g"], p).collect()}
    assert q(0.25)["a"] == 2.75 and q(0.5)["a"] == 5 and q(0.25)["b"] == 7 and q(0.25)["c"] is None and q(0.1)["d"] == 1 and q(0.99)["d"] == 2


def test_binary_columns(spark):
    raw = bytes(range(0, 240, 10))
    row = spark.createDataFrame([(bytearray(raw),)], "b binary")
    r = row.select(C.raw_to_uint8(F.col("b")).alias("u1"), C.raw_to_int8(F.col("b")).alias("i1"), C.raw_to_uint16(F.col("b")).alias("u2"), C.raw_to_int16(F.col("b")).alias("i2"), C.raw_to_uint32(F.col("b")).alias("u4"), C.raw_to_int32(F.col("b")).alias("i4"), C.raw_to_int64(F.col("b")).alias("i8"), C.raw_to_float(F.col("b")).alias("f4")).first()
    for name in ("u1", "i1", "u2", "i2", "u4", "i4", "i8", "f4"):
        assert np.allclose(r[name], np.frombuffer(raw, f"<{name}").astype(float), rtol=1e-12, atol=0), name
    assert spark.createDataFrame([(bytearray(b"ab\0c"),)], "b binary").select(C.raw_to_string(F.col("b"))).first()[0] == "ab"
    with pytest.raises(Exception):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(C.raw_to_uint16(F.col("b"))).collect()


def test_chunks_rejoin(spark):
    x = np.random.default_rng(1).normal(size=101).tolist()
    df = spark.createDataFrame([(1, x), (2, []), (3, None)], "id int, samples array<double>")
    parts = S.chunked(df.where("id = 1"), ["id"], 30, 5)
    back = {r.t: r.value for r in S.unchunk(parts, ["id"]).collect()}
    assert [back[t] for t in range(101)] == x
    out = {r.id: r.samples for r in S.fftfilt(df, ["id"], [1.0]).collect()}
    assert np.allclose(out[1], x) and out[2] is None and out[3] is None


def test_guess_max_integer():
    assert T.guess_max_integer(lambda n: n <= 1234) == 1234
    assert T.guess_max_integer(lambda n: n <= 1234, high=100) == 100
    assert T.guess_max_integer(lambda n: n < 0) is None
