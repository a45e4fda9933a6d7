"""Signal operators: numpy kernels over rows that hold one series each (array<double>), in Arrow batches, without a shuffle.

``ids`` columns are passed through; a null or empty series gives a null result row (or no rows, for operators that give many).
One series must fit in a task; :func:`chunked` cuts long recordings into overlapping pieces first where the maths allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.functions import columns as C
from voxelwave.functions import design, dsp
from voxelwave.operators.tensor import arrays_to_long
from voxelwave.runtime import ship

COMPLEX = "array<struct<re:double,im:double>>"


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _series(column: pa.Array) -> list[np.ndarray | None]:
    kind = column.type.value_type
    if pa.types.is_struct(kind):
        out = []
        for s in column:
            if not s.is_valid or len(s.values) == 0:
                out.append(None)
                continue
            re, im = (f.cast(pa.float64()).to_numpy(zero_copy_only=False) for f in s.values.flatten())
            out.append(re + 1j * im)
        return out
    return [s.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if s.is_valid and len(s.values) else None for s in column]


#: Rows of results that one Arrow batch should hold.
OUT_ROWS = 1 << 16


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; arrays become lists straight from their buffers."""
    if not pa.types.is_list(kind) or not all(v is None or (isinstance(v, np.ndarray) and v.ndim == 1) for v in values):
        return pa.array([v.tolist() if isinstance(v, np.ndarray) else v for v in values], kind)
    offsets = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([v for v in values if v is not None] or [np.zeros(0)])
    inner = kind.value_type
    if pa.types.is_struct(inner):
        data = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], fields=list(inner))
    else:
        data = pa.array(flat).cast(inner)
    return pa.ListArray.from_arrays(pa.array(offsets), data, type=kind, mask=pa.array([v is None for v in values]))


def map_series(df: DataFrame, ids: Sequence[str], kernel: Callable, schema: str, samples: str = "samples") -> DataFrame:
    """One result row a series; the kernel returns a dict of the schema's columns."""
    ship(df.sparkSession)
    names = [p.strip().split(" ")[0] for p in _split(schema)]
    n = len(ids)
    out_schema = _ddl(df, ids) + schema

    def run(batches):
        for b in batches:
            made = [None if x is None else kernel(x) for x in _series(b.column(n))]
            cols = [_column([None if m is None else m[k] for m in made], t) for k, t in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], [*ids, *names])

    kinds = _arrow_types(df, schema)
    return df.select(*ids, samples).mapInArrow(run, out_schema)


def explode_series(df: DataFrame, ids: Sequence[str], kernel: Callable, schema: str, samples: str = "samples") -> DataFrame:
    """Many result rows a series; the kernel returns a dict of equally long columns."""
    ship(df.sparkSession)
    names = [p.strip().split(" ")[0] for p in _split(schema)]
    n = len(ids)
    kinds = _arrow_types(df, schema)

    def packed(b, rows, made):
        sizes = [len(m[names[0]]) for m in made]
        at = pa.array(np.repeat(rows, sizes))
        cols = []
        for k, t in zip(names, kinds):
            parts = [m[k] for m in made]
            if all(isinstance(v, np.ndarray) and v.ndim == 1 and v.dtype != object for v in parts):
                cols.append(pa.array(np.concatenate(parts)).cast(t))
            else:
                cols.append(_column([v for p in parts for v in p], t))
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:n]), *cols], [*ids, *names])

    def run(batches):
        for b in batches:
            rows, made, size = [], [], 0
            for r, x in enumerate(_series(b.column(n))):
                if x is None:
                    continue
                one = kernel(x)
                if len(one[names[0]]):
                    rows.append(r)
                    made.append(one)
                    size += len(one[names[0]])
                if size >= OUT_ROWS:
                    yield packed(b, rows, made)
                    rows, made, size = [], [], 0
            if rows:
                yield packed(b, rows, made)

    return df.select(*ids, samples).mapInArrow(run, _ddl(df, ids) + schema)


def _split(schema: str) -> list[str]:
    out, depth, piece = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(piece)
            piece = ""
        else:
            piece += c
    return [*out, piece]


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]


# ---------------------------------------------------------------- transforms


def fft(df: DataFrame, ids: Sequence[str], full: bool = True, samples: str = "samples") -> DataFrame:
    return map_series(df, ids, lambda x: {"spectrum": dsp.fft_c2c(x) if np.iscomplexobj(x) else dsp.fft_r2c(x, full)}, f"spectrum {COMPLEX}", samples)


def ifft(df: DataFrame, ids: Sequence[str], real: bool = True, full: bool = True, samples: str = "spectrum") -> DataFrame:
    """Inverse transforms are not divided by n."""
    if real:
        return map_series(df, ids, lambda z: {"samples": dsp.fft_c2r(z, full)}, "samples array<double>", samples)
    return map_series(df, ids, lambda z: {"samples": dsp.fft_c2c(z, True)}, f"samples {COMPLEX}", samples)


def fft_complex(df: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    """Forward transform of complex series (arrays of re, im)."""
    return map_series(df, ids, lambda z: {"spectrum": dsp.fft_c2c(z)}, f"spectrum {COMPLEX}", samples)


def unwrap(df: DataFrame, ids: Sequence[str], tol: float = np.pi, samples: str = "samples") -> DataFrame:
    """Phases without jumps of more than ``tol``."""
    return map_series(df, ids, lambda x: {"samples": dsp.unwrap(x, tol)}, "samples array<double>", samples)


def sine_integral(df: DataFrame, ids: Sequence[str], x: str) -> DataFrame:
    """(ids, value): Si of a column, a batch at a time."""
    ship(df.sparkSession)
    n = len(ids)

    def run(batches):
        for b in batches:
            v = b.column(n).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(dsp.sineint(v) if len(v) else v, pa.float64(), from_pandas=True)], [*ids, "value"])

    return df.select(*ids, x).mapInArrow(run, _ddl(df, ids) + "value double")


def fft_nd(df: DataFrame, ids: Sequence[str], shape: Sequence[int], inverse: bool = False, samples: str = "samples") -> DataFrame:
    """Two- and three-dimensional transforms of flattened (row-major) images and volumes."""
    return map_series(df, ids, lambda x: {"spectrum": dsp.fft_nd(x.reshape(shape).astype(complex), inverse).reshape(-1)}, f"spectrum {COMPLEX}", samples)


def hilbert(df: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    return map_series(df, ids, lambda x: {"analytic": dsp.hilbert(x)}, f"analytic {COMPLEX}", samples)


def convolve(df: DataFrame, ids: Sequence[str], kernel, shape: Sequence[int] | None = None, samples: str = "samples") -> DataFrame:
    k = np.asarray(kernel, float)
    return map_series(df, ids, lambda x: {"samples": dsp.convolve_same(x.reshape(shape or x.shape), k).reshape(-1)}, "samples array<double>", samples)


# ---------------------------------------------------------------- filters


def _filtered(df, ids, kernel, samples):
    """A null for a series that is too short for the filter's edges."""
    def run(x):
        try:
            return {"samples": kernel(x)}
        except dsp.TooShort:
            return {"samples": None}

    return map_series(df, ids, run, "samples array<double>", samples)


def filter_signal(df: DataFrame, ids: Sequence[str], b, a=(1.0,), samples: str = "samples") -> DataFrame:
    """(samples, state): output and final delay line."""
    def run(x):
        y, z = dsp.lfilter(b, a, x)
        return {"samples": y, "state": z}

    return map_series(df, ids, run, "samples array<double>, state array<double>", samples)


def filtfilt(df: DataFrame, ids: Sequence[str], spec: design.FilterSpec | None = None, b=None, a=(1.0,), samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, spec.apply if spec is not None else lambda x: dsp.filtfilt(b, a, x), samples)


def fftfilt(df: DataFrame, ids: Sequence[str], b, n: int | None = None, samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, lambda x: dsp.fftfilt(b, x, n), samples)


def notch_filter(df: DataFrame, ids: Sequence[str], srate: float, lower=(59, 118, 178), upper=(61, 122, 182), samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, lambda x: dsp.notch(x, srate, lower, upper), samples)


def band_pass1(df: DataFrame, ids: Sequence[str], srate: float, low: float, high: float, samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, lambda x: dsp.band_pass1(x, srate, low, high), samples)


def band_pass2(df: DataFrame, ids: Sequence[str], srate: float, low: float, high: float, samples: str = "samples", **options) -> DataFrame:
    return _filtered(df, ids, lambda x: design.band_pass2(x, srate, low, high, **options), samples)


def decimate(df: DataFrame, ids: Sequence[str], q: int, order: int | None = None, kind: str = "fir", samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, lambda x: dsp.decimate(x, q, order, kind), samples)


def resample(df: DataFrame, ids: Sequence[str], up: int, down: int, samples: str = "samples") -> DataFrame:
    return _filtered(df, ids, lambda x: dsp.resample(x, up, down), samples)


def design_filter(df: DataFrame, ids: Sequence[str], srate: float, method: str = "fir_kaiser", samples: str = "samples", **options) -> DataFrame:
    """Designed once on the driver, applied forward and backward to every series."""
    return filtfilt(df, ids, design.design_filter(srate, method, **options), samples=samples)


# ---------------------------------------------------------------- spectra


def welch(df: DataFrame, ids: Sequence[str], fs: float, window: int = 64, overlap: float | None = None, nfft: int | None = None, family: str = "hamming", samples: str = "samples") -> DataFrame:
    """(ids, bin, freq, power, power_db, db_se)."""
    def run(x):
        r = dsp.welch(x, fs, window, overlap, nfft, family)
        return {"bin": np.arange(len(r["freq"])), **r}

    return explode_series(df, ids, run, "bin int, freq double, power double, power_db double, db_se double", samples)


def welch_native(df: DataFrame, ids: Sequence[str], fs: float, window: int = 64, overlap: float | None = None, nfft: int | None = None, family: str = "hamming", samples: str = "samples") -> DataFrame:
    """The same power by Catalyst alone: slices by higher-order functions, bins by cosine and sine sums.

    For short windows; a transform of m bins costs m times the window a slice, all inside one row's expression.
    """
    overlap = window / 2 if overlap is None else overlap
    hop, starts, nfft = dsp.welch_plan(window, window, overlap, nfft)
    bins = -(-(nfft + 1) // 2)
    tap = dsp.taper(family, window).tolist()
    cos, sin = ([[float(w * f(2 * np.pi * k * j / nfft)) for j, w in enumerate(tap)] for k in range(bins)] for f in (np.cos, np.sin))
    lit = lambda m: F.array(*(F.array(*map(F.lit, row)) for row in m))
    x = df.select(*ids, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(samples) - window, F.lit(0)), F.lit(hop)), lambda s: F.slice(samples, s + 1, window))).alias("slice", "s"))
    ends = (F.get("s", F.lit(window - 1)) - F.get("s", F.lit(0))) / (window - 1)
    flat = x.withColumn("s", F.transform("s", lambda v, i: v - F.get("s", F.lit(0)) - ends * i))
    dot = lambda row: F.aggregate(F.zip_with("s", row, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    spectra = flat.select(*ids, F.posexplode(F.zip_with(lit(cos), lit(sin), lambda c, s: (dot(c) * dot(c) + dot(s) * dot(s)) / window)).alias("bin", "p"))
    freq = F.col("bin") * (fs / 2 / (bins - 1))
    return spectra.groupBy(*ids, "bin").agg(F.avg("p").alias("power")).withColumn("freq", freq)


def welch_pooled(df: DataFrame, fs: float, window: int = 64, overlap: float | None = None, nfft: int | None = None, family: str = "hamming", samples: str = "samples") -> DataFrame:
    """One spectrum over all slices of all series: per-series means weighted by their slices, pre-aggregated."""
    overlap = window / 2 if overlap is None else min(overlap, window - 1)
    hop = max(1, int(window - overlap))

    def run(x):
        p = dsp.welch(x, fs, window, window - hop, nfft, family)
        n = len(range(0, max(len(x) - window + 1, 1), hop))
        return {"bin": np.arange(len(p["freq"])), "freq": p["freq"], "total": p["power"] * n, "n": np.full(len(p["freq"]), n)}

    parts = explode_series(df, [], run, "bin int, freq double, total double, n long", samples)
    return parts.groupBy("bin").agg(F.max("freq").alias("freq"), (F.sum("total") / F.sum("n")).alias("power"))


def morlet_wavelet(df: DataFrame, ids: Sequence[str], freqs, srate: float, wave_num, trend: str = "constant", segment: int | None = None, precision: str = "double", samples: str = "samples") -> DataFrame:
    """(ids, t, freq, re, im): complex coefficients; long series may be cut into overlapping segments."""
    freqs = [float(f) for f in freqs]

    def run(x):
        z = dsp.morlet_segmented(x, freqs, srate, wave_num, segment, trend)
        if precision == "float":
            z = z.astype(np.complex64)
        n, m = z.shape
        return {"t": np.repeat(np.arange(n), m), "freq": np.tile(freqs, n), "re": z.real.reshape(-1).astype(float), "im": z.imag.reshape(-1).astype(float)}

    return explode_series(df, ids, run, "t int, freq double, re double, im double", samples)


def wavelet_cycles(freqs: DataFrame, freq: str = "freq", frequency_range=(2.0, 200.0), cycle_range=(3.0, 20.0)) -> DataFrame:
    return freqs.withColumn("cycles", C.wavelet_cycles(F.col(freq), frequency_range, cycle_range))


def multitaper(df: DataFrame, ids: Sequence[str], fs: float, trend: str = "linear", samples: str = "samples", **plan) -> DataFrame:
    """(ids, time, freq, power)."""
    def run(x):
        r = dsp.multitaper(x, fs, trend, **plan)
        n, m = len(r["time"]), len(r["freq"])
        return {"time": np.repeat(r["time"], m), "freq": np.tile(r["freq"], n), "power": r["power"].reshape(-1)}

    return explode_series(df, ids, run, "time double, freq double, power double", samples)


def gammatone(df: DataFrame, ids: Sequence[str], srate: float, centres, envelope: bool = True, down: int | None = None, samples: str = "samples") -> DataFrame:
    """(ids, t, band, centre, value)."""
    centres = [float(c) for c in centres]

    def run(x):
        g = dsp.gammatone(x, srate, centres, envelope, down)
        n, m = g.shape
        return {"t": np.repeat(np.arange(n), m), "band": np.tile(np.arange(m), n), "centre": np.tile(centres, n), "value": g.reshape(-1)}

    return explode_series(df, ids, run, "t int, band int, centre double, value double", samples)


# ---------------------------------------------------------------- segments


def chunked(df: DataFrame, ids: Sequence[str], size: int, overlap: int, samples: str = "samples") -> DataFrame:
    """Rows (ids, chunk, keep_from, keep_n, samples) of overlapping pieces, so that no task holds a whole recording."""
    step = size - 2 * overlap
    if step <= 0:
        raise ValueError("pieces must be longer than twice the overlap")
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    d = df.select(*ids, samples, F.posexplode(starts).alias("chunk", "_at"))
    lo = F.greatest(F.col("_at") - overlap, F.lit(0))
    hi = F.least(F.col("_at") + step + overlap, n)
    return d.select(*ids, "chunk", (F.col("_at") - lo).alias("keep_from"), F.least(F.lit(step), n - F.col("_at")).alias("keep_n"), F.slice(samples, lo + 1, hi - lo).alias("samples"))


def unchunk(df: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    """The kept parts of processed pieces, in long form."""
    kept = df.withColumn("_k", F.slice(samples, F.col("keep_from") + 1, F.col("keep_n")))
    first = df.groupBy(*ids).agg(F.max("keep_n").alias("_step"))
    return arrays_to_long(kept.join(first, list(ids)), [*ids, "chunk", "_step"], "_k").select(*ids, (F.col("chunk") * F.col("_step") + F.col("t")).alias("t"), "value")


def plot_table(df: DataFrame, ids: Sequence[str], srate: float = 1.0, space: float = 0.995, max_points: int | None = 2000, samples: str = "samples") -> DataFrame:
    """What a stacked trace plot would draw: time, value plus an offset by channel; thinned evenly to ``max_points``, None for all."""
    long = arrays_to_long(df, ids, samples)
    gap = long.agg(F.percentile_approx(F.abs("value"), F.lit(space)).alias("_gap"))
    # one row a channel
    rank = df.select(*ids).distinct().withColumn("_k", F.dense_rank().over(W.orderBy(*ids)))
    size = long.groupBy(*ids).agg(F.max("t").alias("_n"))
    every = F.lit(1) if max_points is None else F.ceil((F.col("_n") + 1) / max_points)
    return long.join(size.join(rank, list(ids)), list(ids)).where(F.col("t") % every == 0).crossJoin(F.broadcast(gap)).select(*ids, (F.col("t") / srate).alias("time"), (F.col("value") - (F.col("_k") - 1) * 2 * F.col("_gap")).alias("y"))


def diagnose_channel(df: DataFrame, ids: Sequence[str], srate: float, window: int | None = None, overlap: float | None = None, max_freq: float = 300, std: float = 3, classes: int = 100, start: float = 0.0, samples: str = "samples") -> DataFrame:
    """(ids, part, k, x, y): what a channel inspection would draw.

    Parts: ``trace`` (time and value; long recordings of a high rate at 100 samples a second), ``boundary`` (plus and minus ``std``
    standard deviations), ``periodogram`` (frequencies of 1 to ``max_freq`` and Welch power) and ``histogram`` (lower edges of
    equal classes from the least to the largest value, and counts).
    """
    window = int(np.ceil(srate * 2)) if window is None else window
    top = min(max_freq, np.floor(srate / 2))

    def run(x):
        step = srate / 100 if srate > 200 and len(x) / srate > 300 else 1.0
        at = np.rint(np.arange(0, len(x) - 1 + 1e-9, step)).astype(int) if len(x) > 1 else np.zeros(1, int)
        edge = std * (x.std(ddof=1) if len(x) > 1 else 0.0)
        p = dsp.welch(x, srate, window, overlap)
        near = (p["freq"] >= 1) & (p["freq"] <= top)
        counts, edges = np.histogram(x, classes)
        parts = {"trace": (start + (np.arange(len(at)) + 1) * step / srate, x[at]), "boundary": (np.array([-1.0, 1.0]), np.array([-edge, edge])), "periodogram": (p["freq"][near], p["power"][near]), "histogram": (edges[:-1], counts.astype(float))}
        names = [n for n, (u, _) in parts.items() for _ in u]
        return {"part": names, "k": np.concatenate([np.arange(len(u)) for u, _ in parts.values()]), "x": np.concatenate([u for u, _ in parts.values()]).astype(float), "y": np.concatenate([v for _, v in parts.values()])}

    return explode_series(df, ids, run, "part string, k int, x double, y double", samples)
