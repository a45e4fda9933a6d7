"""Series functions for SQL: table functions for what gives many rows, Arrow-batched functions for what gives one array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from voxelwave.runtime import ship


def _table(kernel: str, schema: str, module: str) -> type:
    """A table function of an array and optional numbers; a null or empty array gives no rows."""

    class Rows:
        def eval(self, samples, *options):
            import importlib

            if not samples:
                return
            f = getattr(importlib.import_module(f"voxelwave.functions.{module}"), kernel)
            made = f(np.asarray(samples, float), *options)
            names = [c.strip().split(" ")[0] for c in schema.split(",")]
            for row in zip(*(made[n].tolist() for n in names)):
                yield row

    return udtf(Rows, returnType=schema)


def _array(kernel: Callable[[np.ndarray], np.ndarray]):
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None or not len(x) else kernel(np.asarray(x, float)))

    run.__annotations__ = {"samples": pd.Series, "return": pd.Series}
    return pandas_udf(run, "array<double>")


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL; their names.

    ``SELECT id, p.* FROM t, LATERAL vw_find_peaks(t.samples) p``; ``SELECT vw_detrend(samples) FROM t``.
    """
    ship(spark)
    tables = {
        "vw_find_peaks": _table("find_peaks", "index int, value double", "events"),
        "vw_stimpulse_find": _table("stimpulse_find", "onset int, offset int, threshold double", "events"),
        "vw_welch": _table("welch", "freq double, power double", "dsp"),
    }
    for name, f in tables.items():
        spark.udtf.register(name, f)
    from voxelwave.functions import dsp

    arrays = {"vw_detrend": lambda x: dsp.detrend(x), "vw_unwrap": lambda x: dsp.unwrap(x), "vw_envelope": lambda x: np.abs(dsp.hilbert(x))}
    for name, f in arrays.items():
        spark.udf.register(name, _array(f))
    return [*tables, *arrays]
