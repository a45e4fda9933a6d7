"""Event operators: native candidate stages where rules look at neighbours only, kernels where they are greedy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.functions import events as K
from voxelwave.operators.signal import explode_series, map_series
from voxelwave.runtime import ship


def peak_candidates(df: DataFrame, by: Sequence[str], t: str, value: str = "value") -> DataFrame:
    """Local maxima (both ends of a plateau) above the default threshold, by windows and one grouped join."""
    w = W.partitionBy(*by).orderBy(t)
    x = F.col(value)
    stats = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.median(value).alias("_med"), F.stddev_samp(value).alias("_sd"))
    d = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w)).where(((x - F.col("_p")) * (F.col("_n") - x) <= 0) & (F.col("_n") - x < x - F.col("_p")))
    level = F.when(F.col("_lo") >= 0, F.col("_lo")).otherwise(F.col("_med")) + F.col("_sd")
    return d.join(stats, list(by)).where(x > level).select(*by, t, value)


def find_peaks(df: DataFrame, ids: Sequence[str], samples: str = "samples", **options) -> DataFrame:
    """(ids, index, value) of peaks; indices from 0."""
    return explode_series(df, ids, lambda x: K.find_peaks(x, **options), "index int, value double", samples)


def stimpulse_find(df: DataFrame, ids: Sequence[str], srate: float, duration: float, samples: str = "samples", **options) -> DataFrame:
    return explode_series(df, ids, lambda x: K.stimpulse_find(x, srate, duration, **options), "onset int, offset int, threshold double", samples)


def stimpulse_onsets(df: DataFrame, by: Sequence[str], t: str, threshold: float, gap: int, value: str = "value") -> DataFrame:
    """Onsets by windows alone: steps over a threshold, the first of each run of steps not more than ``gap`` apart."""
    w = W.partitionBy(*by).orderBy(t)
    steps = df.withColumn("_d", F.abs(F.lead(value).over(w) - F.col(value))).where(F.col("_d") > threshold)
    return steps.withColumn("_b", F.lag(t).over(w)).where(F.col("_b").isNull() | (F.col(t) - F.col("_b") > gap)).select(*by, F.col(t).alias("onset"))


def stimpulse_extract(df: DataFrame, onsets: DataFrame, by: Sequence[str], t: str, window: tuple[int, int] = (-10, 20), centre: bool = True, value: str = "value") -> DataFrame:
    """(by, onset, offset, value) around onsets: an equi-join on exploded offsets, less each pulse's median."""
    grid = onsets.select(*by, "onset", F.explode(F.sequence(F.lit(window[0]), F.lit(window[1]))).alias("offset")).withColumn("_t", (F.col("onset") + F.col("offset")).cast("long"))
    d = grid.join(df.select(*by, F.col(t).cast("long").alias("_t"), F.col(value).alias("_v")), [*by, "_t"], "left")
    if not centre:
        return d.select(*by, "onset", "offset", F.col("_v").alias("value"))
    med = d.groupBy(*by, "onset").agg(F.median("_v").alias("_m"))
    return d.join(med, [*by, "onset"]).select(*by, "onset", "offset", (F.col("_v") - F.col("_m")).alias("value"))


def stimpulse_align(df: DataFrame, ids: Sequence[str], srate: float, duration: float, window: tuple[int, int] = (-10, 20), samples: str = "samples", **options) -> DataFrame:
    def run(x):
        found = K.stimpulse_find(x, srate, duration, **options)
        return {"onset": found["onset"], "aligned": K.stimpulse_align(x, found["onset"], window)}

    return explode_series(df, ids, run, "onset int, aligned int", samples)


def stimpulse_interpolate(df: DataFrame, ids: Sequence[str], srate: float, duration: float, samples: str = "samples", **options) -> DataFrame:
    def run(x):
        found = K.stimpulse_find(x, srate, duration, **options)
        return {"samples": K.stimpulse_interpolate(x, srate, found["onset"], found["offset"])}

    return map_series(df, ids, run, "samples array<double>", samples)


def interpolate_stimulation(df: DataFrame, ids: Sequence[str], srate: float, samples: str = "samples", **options) -> DataFrame:
    return map_series(df, ids, lambda x: {"samples": K.interpolate_stimulation(x, srate, **options)}, "samples array<double>", samples)


def interpolate_missing(df: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    """NaN samples are filled by a natural spline."""
    return map_series(df, ids, lambda x: {"samples": K.interpolate_missing(x)}, "samples array<double>", samples)


def find_outliers(df: DataFrame, by: Sequence[str], t: str, n_sd: float = 3, duration: int = 1, symmetric: bool = False, value: str = "value") -> DataFrame:
    """Samples beyond n standard deviations in runs of half a duration or more: windows and groupings."""
    x = F.abs(value) if symmetric else F.col(value)
    sd = df.groupBy(*by).agg(F.stddev_samp(value).alias("_sd"))
    hits = df.join(sd, list(by)).where(x > n_sd * F.col("_sd"))
    w = W.partitionBy(*by).orderBy(t)
    tagged = hits.withColumn("_g", F.col(t) - F.row_number().over(w))
    sizes = tagged.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 0.5 * duration)
    return tagged.join(sizes, [*by, "_g"]).select(*by, t, value)


def smooth_signals(df: DataFrame, ids: Sequence[str], n_knots: int = 60, penalty: float = 0.1, samples: str = "samples") -> DataFrame:
    def run(x):
        t = np.arange(len(x), dtype=float)
        return {"samples": K.smoother(t, x, t, 4, n_knots, penalty)}

    return map_series(df, ids, run, "samples array<double>", samples)


def spike_thresholds(df: DataFrame, by: Sequence[str], t: str, segment: int, std_min: float = 5, value: str = "value") -> DataFrame:
    """Threshold by segment: std_min times the median of |x| over 0.6745."""
    seg = F.floor(F.col(t) / segment)
    return df.groupBy(*by, seg.alias("segment")).agg((F.median(F.abs(value)) / 0.6745 * std_min).alias("threshold"))


def spike_detection(df: DataFrame, ids: Sequence[str], srate: float, samples: str = "samples", **options) -> DataFrame:
    return explode_series(df, ids, lambda x: K.spike_detection(x, srate, **options), "index int, threshold double", samples)


def spike_waveforms(df: DataFrame, ids: Sequence[str], srate: float, w_pre: int = 20, w_post: int = 44, samples: str = "samples", **options) -> DataFrame:
    """(ids, spike, waveform)."""
    def run(x):
        at = K.spike_detection(x, srate, w_pre=w_pre, w_post=w_post, **options)["index"]
        return {"spike": at, "waveform": [w.tolist() for w in K.extract_waveforms(x, at, w_pre, w_post)]}

    return explode_series(df, ids, run, "spike int, waveform array<double>", samples)


def haar_coefficients(df: DataFrame, ids: Sequence[str], levels: int = 4, samples: str = "samples") -> DataFrame:
    """Periodic Haar coefficients by higher-order functions alone, coarsest first."""
    d = df.select(*ids, F.col(samples).cast("array<double>").alias("_s"))
    total = lambda at, n: F.aggregate(F.slice("_s", at + 1, n), F.lit(0.0), lambda a, v: a + v)

    def level(width: int, fine: bool):
        """Sums over ``width`` samples, or the first half less the second; each straight from the samples."""
        places = F.sequence(F.lit(0), (F.size("_s") / width).cast("int") - 1)
        half = width // 2
        if fine:
            return F.transform(places, lambda k: (total(k * width, half) - total(k * width + half, half)) / float(width) ** 0.5)
        return F.transform(places, lambda k: total(k * width, width) / float(width) ** 0.5)

    return d.select(*ids, F.concat(level(1 << levels, False), *(level(1 << k, True) for k in range(levels, 0, -1))).alias("coefficients"))


def lilliefors(df: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    def run(x):
        d, p = K.lilliefors(x)
        return {"statistic": d, "p_value": p}

    return map_series(df, ids, run, "statistic double, p_value double", samples)


def haar_features(waveforms: DataFrame, by: Sequence[str], levels: int = 4, samples: str = "waveform", trim: float = 3.0) -> DataFrame:
    """(by, rank, column, statistic): coefficients of a channel's waveforms by their distance from a fitted normal.

    Values beyond ``trim`` standard deviations are left out first. Moments are pre-aggregated; the distance takes a rank by
    coefficient, so its rows are sorted, not gathered.
    """
    ship(waveforms.sparkSession)
    key = [*by, "column"]
    v = haar_coefficients(waveforms, by, levels, samples).select(*by, F.posexplode("coefficients").alias("column", "v"))
    moments = lambda d, names: d.groupBy(*key).agg(F.avg("v").alias(names[0]), F.stddev_samp("v").alias(names[1]), F.count(F.lit(1)).alias(names[2]))
    near = v.join(moments(v, ("_m0", "_s0", "_n0")), key).where((F.coalesce("_s0", F.lit(0.0)) == 0) | (F.abs(F.col("v") - F.col("_m0")) <= trim * F.col("_s0"))).select(*key, "v")
    fitted = near.join(moments(near, ("_m", "_s", "_n")), key)
    # few or equal values are no distance from a normal
    flat = (F.col("_n") < 5) | (F.coalesce("_s", F.lit(0.0)) == 0)
    z = fitted.select(*key, "_n", F.when(~flat, (F.col("v") - F.col("_m")) / F.col("_s")).alias("_z"))
    n = len(key)

    def run(batches):
        for b in batches:
            x = b.column(n + 1).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(K.normal_cdf(x) if len(x) else x, pa.float64(), from_pandas=True)], [*key, "_n", "_z", "_p"])

    ddl = "".join(f"`{c}` {z.schema[c].dataType.simpleString()}, " for c in key)
    p = z.mapInArrow(run, f"{ddl}_n long, _z double, _p double").withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("_z")))
    apart = F.greatest(F.col("_r") / F.col("_n") - F.col("_p"), F.col("_p") - (F.col("_r") - 1) / F.col("_n"))
    d = p.groupBy(*key).agg(F.coalesce(F.max(apart), F.lit(0.0)).alias("statistic"))
    w = W.partitionBy(*by).orderBy(F.desc("statistic"), "column")
    return d.withColumn("rank", F.row_number().over(w)).select(*by, "rank", "column", "statistic")
