"""Readers that spread files over executors: each file is decoded by the task that reads it, through Spark's own file access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelwave.runtime import ship
from voxelwave.sources import codecs

VOXELS = "path string, i int, j int, k int, value double"
META = "path string, dim array<int>, vox2ras array<double>, intent int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of scalar images in long form, in batches of planes."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                data = codecs.read_nifti(raw.as_buffer().to_pybytes())[0]
                data = data.reshape(data.shape[:3]).astype(float)
                i, j = (x.reshape(-1).astype(np.int32) for x in np.meshgrid(*map(np.arange, data.shape[:2]), indexing="ij"))
                for k in range(data.shape[2]):
                    n = len(i)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(i), pa.array(j), pa.array(np.full(n, k, np.int32)), pa.array(data[:, :, k].reshape(-1))], ["path", "i", "j", "k", "value"])

    return _files(spark, path).mapInArrow(run, VOXELS)


def read_nifti_meta(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [codecs.read_nifti(raw.as_buffer().to_pybytes())[1:] for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[int(x) for x in h["dim"]] for _, h in rows], pa.list_(pa.int32())), pa.array([m.reshape(-1).tolist() for m, _ in rows], pa.list_(pa.float64())), pa.array([int(h["intent"]) for _, h in rows], pa.int32())], ["path", "dim", "vox2ras", "intent"])

    return _files(spark, path).mapInArrow(run, META)


def read_warp(spark: SparkSession, path: str) -> DataFrame:
    """Displacements (RAS) of vector images: path, i, j, k, dx, dy, dz."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                field, _ = codecs.read_warp(raw.as_buffer().to_pybytes())
                at = np.stack(np.meshgrid(*map(np.arange, field.shape[:3]), indexing="ij"), -1).reshape(-1, 3).astype(np.int32)
                d = field.reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *(pa.array(at[:, c]) for c in range(3)), *(pa.array(d[:, c]) for c in range(3))], ["path", "i", "j", "k", "dx", "dy", "dz"])

    return _files(spark, path).mapInArrow(run, "path string, i int, j int, k int, dx double, dy double, dz double")


def read_affines(spark: SparkSession, path: str) -> DataFrame:
    """Affines (RAS, by rows) of MATLAB level-4 files."""

    def run(batches):
        for b in batches:
            m = [codecs.read_affine(raw.as_buffer().to_pybytes()).reshape(-1).tolist() for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m, pa.list_(pa.float64()))], ["path", "m"])

    return _files(spark, path).mapInArrow(run, "path string, m array<double>")
