"""Signal queries: embeddings as equally long series (nominal rate 64), event values by user as filters' input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelwave.functions import design, dsp
from voxelwave.operators import signal as S
from voxelwave.operators import tensor as T
from voxelwave.plans.registry import query
from voxelwave.plans.tensor_queries import NUDGE, SERIES, n6, r6, series
from voxelwave.runtime import table

FS = 64.0


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


def user_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.long_to_arrays(series(spark, sf_dir), ["user_id"], "t")


X = "x AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
DFT = f"""{X}, dft AS (SELECT vec_id, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im
FROM x, range(0, 64) r(k) GROUP BY vec_id, k)"""


def _long(df: DataFrame, ids, name="value", samples="samples") -> DataFrame:
    """A row a sample; a series without samples is one row of nulls."""
    return df.select(*ids, F.posexplode_outer(samples).alias("t", "v")).select(*ids, "t", r6(F.col("v")).alias(name))


@query("fft_power", f"WITH {DFT} SELECT vec_id, k, round(re * re + im * im, 6) + 0.0 AS power FROM dft WHERE k <= 32")
def fft_power(spark, sf_dir):
    z = S.fft(signals(spark, sf_dir), ["vec_id"], full=False)
    return z.select("vec_id", F.posexplode("spectrum").alias("k", "z")).select("vec_id", "k", r6(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")).alias("power"))


@query("fft_full", f"WITH {DFT} SELECT vec_id, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM dft")
def fft_full(spark, sf_dir):
    z = S.fft(signals(spark, sf_dir), ["vec_id"])
    return z.select("vec_id", F.posexplode("spectrum").alias("k", "z")).select("vec_id", "k", r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))


@query("ifft_roundtrip", f"WITH {X} SELECT vec_id, t, round(v * 64 + {NUDGE}, 6) + 0.0 AS value FROM x")
def ifft_roundtrip(spark, sf_dir):
    back = S.ifft(S.fft(signals(spark, sf_dir), ["vec_id"]), ["vec_id"])
    return back.select("vec_id", F.posexplode("samples").alias("t", "v")).select("vec_id", "t", n6(F.col("v")).alias("value"))


@query("ifft_complex", f"WITH {X} SELECT vec_id, t, round(v * 64 + {NUDGE}, 6) + 0.0 AS value FROM x")
def ifft_complex(spark, sf_dir):
    back = S.ifft(S.fft(signals(spark, sf_dir), ["vec_id"]), ["vec_id"], real=False)
    return back.select("vec_id", F.posexplode("samples").alias("t", "z")).select("vec_id", "t", n6(F.col("z.re")).alias("value"))


@query("parseval", f"WITH {X} SELECT vec_id, round(sum(v * v) * 64, 6) + 0.0 AS energy FROM x GROUP BY vec_id")
def parseval(spark, sf_dir):
    z = S.fft(signals(spark, sf_dir), ["vec_id"])
    return z.select("vec_id", r6(F.aggregate("spectrum", F.lit(0.0), lambda a, c: a + c["re"] * c["re"] + c["im"] * c["im"])).alias("energy"))


_FFT2 = f"""WITH {X} SELECT vec_id, CAST(p * 8 + q AS INTEGER) AS k, round(sum(v * cos(2 * pi() * (p * (t // 8) + q * (t % 8)) / 8)), 6) + 0.0 AS re,
round(-sum(v * sin(2 * pi() * (p * (t // 8) + q * (t % 8)) / 8)), 6) + 0.0 AS im FROM x, range(0, 8) a(p), range(0, 8) b(q) GROUP BY vec_id, p, q"""
_FFT3 = f"""WITH {X} SELECT vec_id, CAST(p * 16 + q * 4 + s AS INTEGER) AS k, round(sum(v * cos(2 * pi() * (p * (t // 16) + q * (t // 4 % 4) + s * (t % 4)) / 4)), 6) + 0.0 AS re,
round(-sum(v * sin(2 * pi() * (p * (t // 16) + q * (t // 4 % 4) + s * (t % 4)) / 4)), 6) + 0.0 AS im FROM x, range(0, 4) a(p), range(0, 4) b(q), range(0, 4) c(s) GROUP BY vec_id, p, q, s"""


def _nd(name: str, shape: tuple[int, ...], sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        z = S.fft_nd(signals(spark, sf_dir), ["vec_id"], shape)
        return z.select("vec_id", F.posexplode("spectrum").alias("k", "z")).select("vec_id", "k", r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))


_nd("fft_2d", (8, 8), _FFT2)
_nd("fft_3d", (4, 4, 4), _FFT3)


@query("hilbert_envelope", f"""WITH {DFT}, g AS (SELECT vec_id, k, re * CASE WHEN k IN (0, 32) THEN 1 WHEN k < 32 THEN 2 ELSE 0 END AS re, im * CASE WHEN k IN (0, 32) THEN 1 WHEN k < 32 THEN 2 ELSE 0 END AS im FROM dft),
a AS (SELECT vec_id, CAST(t AS INTEGER) AS t, sum(re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64)) / 64 AS re, sum(re * sin(2 * pi() * k * t / 64) + im * cos(2 * pi() * k * t / 64)) / 64 AS im FROM g, range(0, 64) r(t) GROUP BY vec_id, t)
SELECT vec_id, t, round(sqrt(re * re + im * im), 6) + 0.0 AS value FROM a""")
def hilbert_envelope(spark, sf_dir):
    z = S.hilbert(signals(spark, sf_dir), ["vec_id"])
    return z.select("vec_id", F.posexplode("analytic").alias("t", "z")).select("vec_id", "t", r6(F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im"))).alias("value"))


@query("convolve_same", f"""WITH {X} SELECT a.vec_id, a.t, round(0.25 * coalesce(p.v, 0) + 0.5 * a.v + 0.25 * coalesce(n.v, 0), 6) + 0.0 AS value
FROM x a LEFT JOIN x p ON p.vec_id = a.vec_id AND p.t = a.t - 1 LEFT JOIN x n ON n.vec_id = a.vec_id AND n.t = a.t + 1""")
def convolve_same(spark, sf_dir):
    return _long(S.convolve(signals(spark, sf_dir), ["vec_id"], [0.25, 0.5, 0.25]), ["vec_id"])


@query("convolve_image", f"""WITH {X} SELECT a.vec_id, a.t, round(sum(b.v * (1 + abs(a.t // 8 - b.t // 8) + 2 * abs(a.t % 8 - b.t % 8))), 6) + 0.0 AS value FROM x a JOIN x b ON a.vec_id = b.vec_id
AND abs(a.t // 8 - b.t // 8) <= 1 AND abs(a.t % 8 - b.t % 8) <= 1 GROUP BY a.vec_id, a.t""")
def convolve_image(spark, sf_dir):
    k = [[1 + abs(i) + 2 * abs(j) for j in (-1, 0, 1)] for i in (-1, 0, 1)]
    return _long(S.convolve(signals(spark, sf_dir), ["vec_id"], k, (8, 8)), ["vec_id"])


@query("convolve_volume", f"""WITH {X} SELECT a.vec_id, a.t, round(sum(b.v), 6) + 0.0 AS value FROM x a JOIN x b ON a.vec_id = b.vec_id
AND abs(a.t // 16 - b.t // 16) <= 1 AND abs(a.t // 4 % 4 - b.t // 4 % 4) <= 1 AND abs(a.t % 4 - b.t % 4) <= 1 GROUP BY a.vec_id, a.t""")
def convolve_volume(spark, sf_dir):
    return _long(S.convolve(signals(spark, sf_dir), ["vec_id"], np.ones((3, 3, 3)), (4, 4, 4)), ["vec_id"])


TAPS = (0.1, 0.2, 0.4, 0.2, 0.1)


@query("fir_filter", f"""WITH {SERIES}, h AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0.1, 0.2, 0.4, 0.2, 0.1]) AS b)
SELECT a.user_id, a.t, round(sum(CAST(h.b AS DOUBLE) * s.value), 6) + 0.0 AS value FROM series a, h JOIN series s ON s.user_id = a.user_id AND s.t = a.t - h.k GROUP BY ALL""".replace("FROM series a, h JOIN series s ON", "FROM series a CROSS JOIN h JOIN series s ON"))
def fir_filter(spark, sf_dir):
    return _long(S.filter_signal(user_arrays(spark, sf_dir), ["user_id"], TAPS), ["user_id"])


@query("fftfilt", f"""WITH {SERIES}, h AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0.1, 0.2, 0.4, 0.2, 0.1]) AS b)
SELECT a.user_id, a.t, round(sum(CAST(h.b AS DOUBLE) * s.value), 6) + 0.0 AS value FROM series a CROSS JOIN h JOIN series s ON s.user_id = a.user_id AND s.t = a.t - h.k GROUP BY ALL""")
def fftfilt(spark, sf_dir):
    return _long(S.fftfilt(user_arrays(spark, sf_dir), ["user_id"], TAPS, 32), ["user_id"])


_IIR = """WITH RECURSIVE {s}, y AS (
  SELECT user_id, t, 0.2 * value AS value, 0.0::DOUBLE AS before FROM series WHERE t = 0
  UNION ALL SELECT s.user_id, s.t, 0.2 * s.value + 1.1 * y.value - 0.3 * y.before, y.value FROM y JOIN series s ON s.user_id = y.user_id AND s.t = y.t + 1)
SELECT user_id, t, round(value, 6) + 0.0 AS value FROM y"""


@query("iir_filter", _IIR.format(s=SERIES))
def iir_filter(spark, sf_dir):
    return _long(S.filter_signal(user_arrays(spark, sf_dir), ["user_id"], [0.2], [1, -1.1, 0.3]), ["user_id"])


def _zero_phase(m: int, taps: str) -> str:
    """Forward and backward filtering by ``taps`` (k, b) over an odd extension of m samples; shorter series give a row of nulls."""
    return f"""{SERIES}, n AS (SELECT user_id, max(t) AS n FROM series GROUP BY user_id),
e AS (SELECT user_id, t, value FROM series JOIN n USING (user_id) WHERE n.n >= {m}
  UNION ALL SELECT a.user_id, -b.t, 2 * a.value - b.value FROM series a JOIN series b ON a.user_id = b.user_id AND a.t = 0 AND b.t BETWEEN 1 AND {m} JOIN n ON n.user_id = a.user_id AND n.n >= {m}
  UNION ALL SELECT a.user_id, 2 * n.n - b.t, 2 * a.value - b.value FROM n JOIN series a ON a.user_id = n.user_id AND a.t = n.n AND n.n >= {m} JOIN series b ON b.user_id = n.user_id AND b.t BETWEEN n.n - {m} AND n.n - 1),
h AS ({taps}), g AS (SELECT x.k - y.k AS k, sum(x.b * y.b) AS b FROM h x CROSS JOIN h y GROUP BY ALL)
SELECT s.user_id, s.t, round(sum(g.b * e.value), 6) + 0.0 AS value FROM series s JOIN n ON n.user_id = s.user_id AND n.n >= {m} CROSS JOIN g JOIN e ON e.user_id = s.user_id AND e.t = s.t + g.k GROUP BY ALL
UNION ALL SELECT user_id, NULL, NULL FROM n WHERE n.n < {m}"""


@query("fir_filtfilt", "WITH " + _zero_phase(6, "SELECT unnest([0, 1, 2]) AS k, unnest([0.25::DOUBLE, 0.5, 0.25]) AS b"))
def fir_filtfilt(spark, sf_dir):
    return _long(S.filtfilt(user_arrays(spark, sf_dir), ["user_id"], b=[0.25, 0.5, 0.25]), ["user_id"])


def _inverse(gain: str) -> str:
    return f"""WITH {DFT}, g AS (SELECT vec_id, k, least(k, 64 - k) AS j, re, im FROM dft),
m AS (SELECT vec_id, k, {gain} AS w, re, im FROM g)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(sum(w * (re * cos(2 * pi() * k * t / 64) - im * sin(2 * pi() * k * t / 64))) / 64, 6) + 0.0 AS value FROM m, range(0, 64) r(t) GROUP BY vec_id, t"""


@query("notch_spectrum", _inverse("(1 - exp(-10 * pow(CASE WHEN j = 32 THEN 31 ELSE j END - 10, 2))) * (1 - exp(-10 * pow(CASE WHEN j = 32 THEN 31 ELSE j END - 20, 2)))"))
def notch_spectrum(spark, sf_dir):
    return _long(S.notch_filter(signals(spark, sf_dir), ["vec_id"], FS, (9, 19), (11, 21)), ["vec_id"])


@query("bandpass_fft", _inverse("exp(-pow(CASE WHEN j < 8 THEN 8 - j WHEN j > 16 THEN j - 16 ELSE 0 END, 2))"))
def bandpass_fft(spark, sf_dir):
    return _long(S.band_pass1(signals(spark, sf_dir), ["vec_id"], FS, 8, 16), ["vec_id"])


# the ideal band from 0.2 to 0.6 of the Nyquist rate, cut to nine taps by a Hamming taper, of unit gain in its middle
_BAND = """SELECT k, b / abs(sum(b * cos(0.4 * pi() * k)) OVER ()) AS b FROM (SELECT k, (0.54 + 0.46 * cos(pi() * k / 4)) * CASE WHEN k = 0 THEN 0.4 ELSE (sin(0.6 * pi() * k) - sin(0.2 * pi() * k)) / (pi() * k) END AS b FROM range(-4, 5) r(k))"""


@query("bandpass_fir", "WITH " + _zero_phase(24, _BAND))
def bandpass_fir(spark, sf_dir):
    return _long(S.band_pass2(user_arrays(spark, sf_dir), ["user_id"], 1.0, 0.1, 0.3, order=8), ["user_id"])


def _recursive(b, a, z) -> str:
    """One pass of a filter of four states over {src} (user_id, i, x) from its steady state: rows {name} (user_id, i, y, states)."""
    def step(state: list[str]) -> str:
        y = f"({float(b[0])!r} * x.x + {state[0]})"
        return ", ".join([y, *(f"{float(b[k])!r} * x.x - {float(a[k])!r} * {y}" + (f" + {state[k]}" if k < 4 else "") for k in range(1, 5))])

    first = step([f"{float(v)!r} * x.x" for v in z]).split(", ")
    named = ", ".join(f"{e} AS {n}" for e, n in zip(first, ("y", "z1", "z2", "z3", "z4")))
    return f"""SELECT x.user_id, x.i, {named} FROM {{src}} x WHERE x.i = 0
UNION ALL SELECT x.user_id, x.i, {step([f"p.z{k}" for k in range(1, 5)])} FROM {{name}} p JOIN {{src}} x ON x.user_id = p.user_id AND x.i = p.i + 1"""


def _butter_sql(m: int) -> str:
    """Forward and backward recursions over an odd extension of m samples; shorter series give a row of nulls."""
    spec = design.butter(2, [0.2, 0.6], "pass")
    once = _recursive(spec.b, spec.a, dsp.steady_state(spec.b, spec.a))
    return f"""WITH RECURSIVE {SERIES}, n AS (SELECT user_id, max(t) AS n FROM series GROUP BY user_id),
e AS (SELECT user_id, t, CAST(value AS DOUBLE) AS value FROM series JOIN n USING (user_id) WHERE n.n >= {m}
  UNION ALL SELECT a.user_id, -b.t, 2 * a.value - b.value FROM series a JOIN series b ON a.user_id = b.user_id AND a.t = 0 AND b.t BETWEEN 1 AND {m} JOIN n ON n.user_id = a.user_id AND n.n >= {m}
  UNION ALL SELECT a.user_id, 2 * n.n - b.t, 2 * a.value - b.value FROM n JOIN series a ON a.user_id = n.user_id AND a.t = n.n AND n.n >= {m} JOIN series b ON b.user_id = n.user_id AND b.t BETWEEN n.n - {m} AND n.n - 1),
fin AS MATERIALIZED (SELECT user_id, CAST(t + {m} AS INTEGER) AS i, value AS x FROM e), fout AS ({once.format(src="fin", name="fout")}),
bin AS MATERIALIZED (SELECT f.user_id, CAST(n.n + {2 * m} - f.i AS INTEGER) AS i, f.y AS x FROM fout f JOIN n USING (user_id)), bout AS ({once.format(src="bin", name="bout")})
SELECT b.user_id, CAST(n.n + {m} - b.i AS INTEGER) AS t, round(b.y, 6) + 0.0 AS value FROM bout b JOIN n USING (user_id) WHERE n.n + {m} - b.i BETWEEN 0 AND n.n
UNION ALL SELECT user_id, NULL, NULL FROM n WHERE n.n < {m}"""


@query("bandpass_butter", _butter_sql(12))
def bandpass_butter(spark, sf_dir):
    return _long(S.band_pass2(user_arrays(spark, sf_dir), ["user_id"], 1.0, 0.1, 0.3, order=2, method="butter"), ["user_id"])


# the ideal low pass at a quarter of the Nyquist rate, 31 taps under a Hamming taper, over an odd extension
@query("decimate_fir", f"""WITH {X}, h AS (SELECT k, b / sum(b) OVER () AS b FROM (SELECT k, (0.54 + 0.46 * cos(pi() * k / 15)) * CASE WHEN k = 0 THEN 0.25 ELSE sin(0.25 * pi() * k) / (pi() * k) END AS b FROM range(-15, 16) r(k))),
e AS (SELECT vec_id, t, v FROM x UNION ALL SELECT a.vec_id, -b.t, 2 * a.v - b.v FROM x a JOIN x b USING (vec_id) WHERE a.t = 0 AND b.t BETWEEN 1 AND 15
  UNION ALL SELECT a.vec_id, 126 - b.t, 2 * a.v - b.v FROM x a JOIN x b USING (vec_id) WHERE a.t = 63 AND b.t BETWEEN 48 AND 62)
SELECT vec_id, CAST(s // 4 AS INTEGER) AS t, round(sum(b * v), 6) + 0.0 AS value FROM range(0, 64, 4) r(s) CROSS JOIN h JOIN e ON e.t = s - h.k GROUP BY ALL""")
def decimate_fir(spark, sf_dir):
    return _long(S.decimate(signals(spark, sf_dir), ["vec_id"], 4), ["vec_id"])


# a Kaiser taper's Bessel functions by their series; the divisor goes with the scale to three
@query("resample_3_2", f"""WITH {X}, ka AS (SELECT k, sum(pow(6.25 * (1 - pow(k / 30.0, 2)), m) / pow(gamma(m + 1), 2)) AS w FROM range(-30, 31) r(k), range(0, 40) q(m) GROUP BY k),
h AS (SELECT k, 3 * b / sum(b) OVER () AS b FROM (SELECT k, w * CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3) / (pi() * k / 3) END AS b FROM ka))
SELECT vec_id, CAST(o AS INTEGER) AS t, round(sum(b * v), 6) + 0.0 AS value FROM range(0, 96) r(o) JOIN h ON true JOIN x ON 2 * o - 3 * x.t = h.k GROUP BY ALL""")
def resample_3_2(spark, sf_dir):
    return _long(S.resample(signals(spark, sf_dir), ["vec_id"], 3, 2), ["vec_id"])


W_, HOP, NFFT = 16, 8, 16
_WELCH = f"""{X}, st AS (SELECT vec_id, label, unnest(range(0, 49, 8)) AS s FROM embeddings),
sl AS (SELECT st.vec_id, st.s, x.t - st.s AS i, x.v, first_value(x.v) OVER w AS a, last_value(x.v) OVER w AS b FROM st JOIN x ON x.vec_id = st.vec_id AND x.t BETWEEN st.s AND st.s + 15
  WINDOW w AS (PARTITION BY st.vec_id, st.s ORDER BY x.t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tp AS (SELECT vec_id, s, i, (v - a - (b - a) / 15 * i) * (0.54 - 0.46 * cos(2 * pi() * i / 15)) AS v FROM sl),
pw AS (SELECT vec_id, s, CAST(k AS INTEGER) AS bin, (pow(sum(v * cos(2 * pi() * k * i / {{n}})), 2) + pow(sum(v * sin(2 * pi() * k * i / {{n}})), 2)) / 16 AS p FROM tp, range(0, {{m}}) r(k) GROUP BY vec_id, s, k)"""
_W16 = _WELCH.format(n=16, m=9)


@query("welch_power", f"WITH {_W16} SELECT vec_id, bin, round(bin * 4.0, 6) + 0.0 AS freq, round(avg(p), 6) + 0.0 AS power FROM pw GROUP BY vec_id, bin")
def welch_power(spark, sf_dir):
    return S.welch(signals(spark, sf_dir), ["vec_id"], FS, 16, 8, 16).select("vec_id", "bin", r6(F.col("freq")).alias("freq"), r6(F.col("power")).alias("power"))


@query("welch_native", f"WITH {_W16} SELECT vec_id, bin, round(avg(p), 6) + 0.0 AS power FROM pw GROUP BY vec_id, bin")
def welch_native(spark, sf_dir):
    return S.welch_native(signals(spark, sf_dir), ["vec_id"], FS, 16, 8, 16).select("vec_id", "bin", r6(F.col("power")).alias("power"))


@query("welch_db", f"WITH {_W16} SELECT vec_id, bin, round(avg(10 * log10(p)), 6) + 0.0 AS power_db, round(stddev_samp(10 * log10(p)) / sqrt(count(*) - 1), 6) + 0.0 AS db_se FROM pw WHERE bin > 0 GROUP BY vec_id, bin")
def welch_db(spark, sf_dir):
    return S.welch(signals(spark, sf_dir), ["vec_id"], FS, 16, 8, 16).where("bin > 0").select("vec_id", "bin", r6(F.col("power_db")).alias("power_db"), r6(F.col("db_se")).alias("db_se"))


@query("welch_pooled", f"WITH {_W16} SELECT bin, round(bin * 4.0, 6) + 0.0 AS freq, round(avg(p), 6) + 0.0 AS power FROM pw GROUP BY bin")
def welch_pooled(spark, sf_dir):
    return S.welch_pooled(signals(spark, sf_dir), FS, 16, 8, 16).select("bin", r6(F.col("freq")).alias("freq"), r6(F.col("power")).alias("power"))


@query("welch_band_power", f"""WITH {_W16}, b AS (SELECT vec_id, bin, avg(p) AS p FROM pw GROUP BY vec_id, bin)
SELECT label, CASE WHEN bin * 4 < 8 THEN 'low' WHEN bin * 4 < 20 THEN 'mid' ELSE 'high' END AS band, round(avg(p), 6) + 0.0 AS power FROM b JOIN embeddings USING (vec_id) GROUP BY ALL""")
def welch_band_power(spark, sf_dir):
    p = S.welch(signals(spark, sf_dir), ["vec_id", "label"], FS, 16, 8, 16)
    band = F.when(F.col("freq") < 8, "low").when(F.col("freq") < 20, "mid").otherwise("high")
    return p.groupBy("label", band.alias("band")).agg(r6(F.avg("power")).alias("power"))


@query("wavelet_cycles", """SELECT CAST(f AS DOUBLE) AS freq, round(exp(ln(3) + (ln(f) - ln(2)) * (ln(20) - ln(3)) / (ln(200) - ln(2))), 6) + 0.0 AS cycles FROM range(2, 201, 2) r(f)""")
def wavelet_cycles(spark, sf_dir):
    f = spark.range(2, 201, 2).select(F.col("id").cast("double").alias("freq"))
    return S.wavelet_cycles(f).select("freq", r6(F.col("cycles")).alias("cycles"))


# cycles run from 2 to 4 in log frequency; a kernel's centre is its middle sample, the series wraps
_MORLET = """fr AS (SELECT f, c / (2 * pi() * f) AS st FROM (SELECT f, exp(ln(2) + ln(f / 4.0) * ln(2) / ln(4)) AS c FROM (SELECT unnest([4, 8, 12, 16]) AS f))),
ks AS (SELECT f, st, CAST(floor(6 * st * 64 + 1e-7) AS INTEGER) + 1 AS n FROM fr),
ke AS (SELECT f, i - (n - 1) // 2 AS d, exp(-pow(i / 64.0 - 3 * st, 2) / (2 * st * st)) / sqrt(st * sqrt(pi())) AS g FROM ks JOIN range(0, 64) r(i) ON i < n)"""


@query("wavelet_power", f"""WITH {X}, {_MORLET}, mx AS (SELECT vec_id, label, t, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM x),
z AS (SELECT vec_id, any_value(label) AS label, f, CAST((t - d + 128) % 64 AS INTEGER) AS t, sum(v * g * cos(2 * pi() * f * d / 64)) / sqrt(32) AS re, -sum(v * g * sin(2 * pi() * f * d / 64)) / sqrt(32) AS im FROM mx CROSS JOIN ke GROUP BY vec_id, f, (t - d + 128) % 64)
SELECT label, CAST(f AS DOUBLE) AS freq, t, round(avg(re * re + im * im), 6) + 0.0 AS power FROM z GROUP BY ALL""")
def wavelet_power(spark, sf_dir):
    z = S.morlet_wavelet(signals(spark, sf_dir), ["vec_id", "label"], (4, 8, 12, 16), FS, (2, 4))
    return z.groupBy("label", "freq", "t").agg(r6(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("power"))


_TAPERS = dsp.dpss(32, 3, 4) * np.sqrt(FS)
_DPSS = "tp AS (SELECT unnest(range(0, 128)) // 32 AS j, unnest(range(0, 128)) % 32 AS i, unnest([" + ", ".join(f"{v!r}::DOUBLE" for v in _TAPERS.reshape(-1).tolist()) + "]) AS h)"


@query("multitaper_power", f"""WITH {X}, {_DPSS}, st AS (SELECT vec_id, unnest([0, 16, 32]) AS s FROM embeddings),
sl AS (SELECT st.vec_id, st.s, x.t - st.s AS i, x.v FROM st JOIN x ON x.vec_id = st.vec_id AND x.t BETWEEN st.s AND st.s + 31),
mn AS (SELECT vec_id, s, avg(v) AS m FROM sl GROUP BY vec_id, s),
pw AS (SELECT sl.vec_id, sl.s, j, k, pow(sum((v - m) * h * cos(2 * pi() * k * sl.i / 32)), 2) + pow(sum((v - m) * h * sin(2 * pi() * k * sl.i / 32)), 2) AS p FROM sl JOIN mn USING (vec_id, s) JOIN tp ON tp.i = sl.i, range(0, 16) r(k) GROUP BY sl.vec_id, sl.s, j, k)
SELECT vec_id, round((s + 1 + 16) / 64.0, 6) + 0.0 AS time, round(1.0 + 2 * k, 6) + 0.0 AS freq, round(avg(p) / 4096, 6) + 0.0 AS power FROM pw GROUP BY vec_id, s, k""".replace("JOIN tp ON tp.i = sl.i, range(0, 16) r(k)", "JOIN tp ON tp.i = sl.i CROSS JOIN range(0, 16) r(k)"))
def multitaper_power(spark, sf_dir):
    m = S.multitaper(signals(spark, sf_dir), ["vec_id"], FS, "constant", window=(0.5, 0.25), time_bandwidth=3, tapers=4)
    return m.select("vec_id", *(r6(F.col(c)).alias(c) for c in ("time", "freq", "power")))


# four centres evenly spread on the ERB scale; fourth-order kernels of 9 samples of unit peak gain; Hilbert envelopes by transforms
@query("gammatone_bands", f"""WITH {X}, ce AS (SELECT band, (pow(10, (lo + (hi - lo) * band / 3.0) / 21.4) - 1) / 0.00437 AS f FROM (SELECT 21.4 * log10(1 + 0.00437 * 4) AS lo, 21.4 * log10(1 + 0.00437 * 24) AS hi), range(0, 4) r(band)),
bw AS (SELECT band, f, 1.019 * 2 * pi() * 24.7 * (0.00437 * f + 1) AS b FROM ce),
kr AS (SELECT band, i, round(3 / b * 64) AS lag, pow(i / 64.0, 3) * exp(-b * i / 64.0) * cos(2 * pi() * f * (i / 64.0 - 3 / b)) AS k FROM bw, range(0, 9) r(i)),
ga AS (SELECT band, max(m) AS gain FROM (SELECT band, j, sqrt(pow(sum(k * cos(2 * pi() * i * j / 128)), 2) + pow(sum(k * sin(2 * pi() * i * j / 128)), 2)) AS m FROM kr, range(0, 65) q(j) GROUP BY band, j) GROUP BY band),
y AS (SELECT vec_id, band, CAST(t + i - lag AS INTEGER) AS t, sum(v * k / gain) AS v FROM x CROSS JOIN kr JOIN ga USING (band) WHERE t + i - lag BETWEEN 0 AND 63 GROUP BY ALL),
df AS (SELECT vec_id, band, j, sum(v * cos(2 * pi() * j * t / 64)) AS re, -sum(v * sin(2 * pi() * j * t / 64)) AS im FROM y, range(0, 33) q(j) GROUP BY ALL),
an AS (SELECT vec_id, band, t, sum(w * (re * cos(2 * pi() * j * t / 64) - im * sin(2 * pi() * j * t / 64))) / 64 AS re, sum(w * (re * sin(2 * pi() * j * t / 64) + im * cos(2 * pi() * j * t / 64))) / 64 AS im
  FROM (SELECT *, CASE WHEN j IN (0, 32) THEN 1 ELSE 2 END AS w FROM df), range(0, 64) r(t) GROUP BY vec_id, band, t)
SELECT vec_id, CAST(band AS INTEGER) AS band, round(avg(sqrt(re * re + im * im)), 6) + 0.0 AS envelope FROM an GROUP BY vec_id, band""")
def gammatone_bands(spark, sf_dir):
    g = S.gammatone(signals(spark, sf_dir), ["vec_id"], FS, dsp.erb_centres(4, 24, 4))
    return g.groupBy("vec_id", "band").agg(r6(F.avg("value")).alias("envelope"))


@query("design_filters")
def design_filters(spark, sf_dir):
    """A table of designs: order, condition and attenuation at the edges."""
    rows = []
    for method in ("fir_kaiser", "firls", "fir_remez", "butter", "cheby1", "cheby2", "ellip"):
        spec = design.design_filter(500.0, method, high_pass=4.0, low_pass=40.0)
        for c in spec.checks:
            rows.append((method, int(spec.parameters["order"]), round(float(c["frequency"]), 6), round(float(min(c["attenuation_db"], 400.0)), 3), round(float(c["rcond"]), 12)))
    return spark.createDataFrame(rows, "method string, filter_order int, frequency double, attenuation_db double, rcond double")


@query("freqz", "WITH h AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0.1, 0.2, 0.4, 0.2, 0.1]) AS b) SELECT CAST(n AS INTEGER) AS bin, round(10 * log10(pow(sum(CAST(b AS DOUBLE) * cos(pi() * n * k / 64)), 2) + pow(sum(CAST(b AS DOUBLE) * sin(pi() * n * k / 64)), 2)), 6) + 0.0 AS magnitude_db FROM h, range(0, 64) r(n) GROUP BY n")
def freqz(spark, sf_dir):
    f, h = design.freqz(TAPS, 1, n=64)
    rows = [(k, round(float(20 * np.log10(abs(v))), 6)) for k, v in enumerate(h)]
    return spark.createDataFrame(rows, "bin int, magnitude_db double")


# closed forms of the squared gains, with frequencies bent as the bilinear transform bends them
_GAINS = {
    "butter_low": (lambda: design.butter(4, 0.3, "low"), "1 / (1 + pow(o / tan(pi() * 0.15), 8))"),
    "butter_high": (lambda: design.butter(3, 0.25, "high"), "1 / (1 + pow(tan(pi() * 0.125) / o, 6))"),
    "butter_pass": (lambda: design.butter(2, [0.2, 0.6], "pass"), "1 / (1 + pow((o * o - tan(pi() * 0.1) * tan(pi() * 0.3)) / ((tan(pi() * 0.3) - tan(pi() * 0.1)) * o), 4))"),
    "butter_stop": (lambda: design.butter(2, [0.2, 0.6], "stop"), "1 / (1 + pow((tan(pi() * 0.3) - tan(pi() * 0.1)) * o / (o * o - tan(pi() * 0.1) * tan(pi() * 0.3)), 4))"),
    "cheby1_low": (lambda: design.cheby1(3, 1.0, 0.4, "low"), "1 / (1 + (pow(10, 0.1) - 1) * pow(4 * pow(o / tan(pi() * 0.2), 3) - 3 * o / tan(pi() * 0.2), 2))"),
    "cheby2_low": (lambda: design.cheby2(4, 40.0, 0.5, "low"), "1 / (1 + (pow(10, 4) - 1) / pow(8 * pow(tan(pi() * 0.25) / o, 4) - 8 * pow(tan(pi() * 0.25) / o, 2) + 1, 2))"),
}


@query("design_gains", " UNION ALL ".join(f"SELECT '{n}' AS design, CAST(k AS INTEGER) AS k, round({e}, 6) + 0.0 AS gain FROM (SELECT k, tan(pi() * k / 128.0) AS o FROM range(1, 64) r(k))" for n, (_, e) in _GAINS.items()))
def design_gains(spark, sf_dir):
    """Squared gains of recursive designs on a grid of frequencies."""
    rows = []
    for name, (make, _) in _GAINS.items():
        spec = make()
        _, h = design.freqz(spec.b, spec.a, n=64)
        rows += [(name, k, float(abs(h[k]) ** 2)) for k in range(1, 64)]
    return spark.createDataFrame(rows, "design string, k int, gain double").select("design", "k", r6(F.col("gain")).alias("gain"))


@query("sos_filtfilt", _butter_sql(15))
def sos_filtfilt(spark, sf_dir):
    """Second-order sections: the same recursion, over the edges that two sections ask for."""
    return _long(S.filtfilt(user_arrays(spark, sf_dir), ["user_id"], design.butter(2, [0.2, 0.6], "pass")), ["user_id"])


@query("filter_state", _IIR.format(s=SERIES).replace("SELECT user_id, t, round(value, 6) + 0.0 AS value FROM y", "SELECT user_id, round(arg_max(1.1 * value - 0.3 * before, t), 6) + 0.0 AS z1, round(arg_max(-0.3 * value, t), 6) + 0.0 AS z2 FROM y GROUP BY user_id"))
def filter_state(spark, sf_dir):
    """The delay line that a filter hands on."""
    d = S.filter_signal(user_arrays(spark, sf_dir), ["user_id"], [0.2], [1, -1.1, 0.3])
    return d.select("user_id", r6(F.get("state", F.lit(0))).alias("z1"), r6(F.get("state", F.lit(1))).alias("z2"))


@query("fft_complex", f"""WITH {X} SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(v * cos(2 * pi() * k * t / 64) + v * t / 64.0 * sin(2 * pi() * k * t / 64)), 6) + 0.0 AS re,
round(sum(v * t / 64.0 * cos(2 * pi() * k * t / 64) - v * sin(2 * pi() * k * t / 64)), 6) + 0.0 AS im FROM x, range(0, 64) r(k) GROUP BY vec_id, k""")
def fft_complex(spark, sf_dir):
    """Forward transform of complex series."""
    z = signals(spark, sf_dir).select("vec_id", F.transform("samples", lambda v, i: F.struct(v.alias("re"), (v * i / 64.0).alias("im"))).alias("samples"))
    out = S.fft_complex(z, ["vec_id"])
    return out.select("vec_id", F.posexplode("spectrum").alias("k", "z")).select("vec_id", "k", r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))


@query("sine_integral", """SELECT CAST(k AS INTEGER) AS k, round(sum(pow(-1, m) * pow(k / 8.0, 2 * m + 1) / ((2 * m + 1) * gamma(2 * m + 2))), 6) + 0.0 AS value FROM range(0, 65) r(k), range(0, 40) q(m) GROUP BY k""")
def sine_integral(spark, sf_dir):
    grid = spark.range(0, 65).select(F.col("id").cast("int").alias("k"))
    return S.sine_integral(grid.withColumn("x", F.col("k") / 8.0), ["k"], "x").select("k", r6(F.col("value")).alias("value"))


@query("unwrap_phase", """WITH p AS (SELECT CAST(k AS INTEGER) AS k, 0.9 * k AS phase FROM range(0, 64) r(k)) SELECT k, round(phase, 6) + 0.0 AS value FROM p""")
def unwrap_phase(spark, sf_dir):
    """A phase that grows by 0.9 a sample, wrapped to (-pi, pi] and unwrapped again."""
    k = F.sequence(F.lit(0), F.lit(63))
    d = spark.range(1).select("id", F.transform(k, lambda v: F.atan2(F.sin(v * 0.9), F.cos(v * 0.9))).alias("samples"))
    return S.unwrap(d, ["id"]).select(F.posexplode("samples").alias("k", "v")).select("k", r6(F.col("v")).alias("value"))


@query("diagnose_channel", f"""WITH {X}, st AS (SELECT vec_id, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM x GROUP BY vec_id),
h AS (SELECT vec_id, least(7, CAST(floor((v - lo) / ((hi - lo) / 8)) AS INTEGER)) AS k FROM x JOIN st USING (vec_id))
SELECT vec_id, 'trace' AS part, t AS k, round((t + 1) / 64.0, 6) + 0.0 AS x, round(v, 6) + 0.0 AS y FROM x
UNION ALL SELECT vec_id, 'boundary', CAST(s AS INTEGER), 2.0 * s - 1, round((2 * s - 1) * 3 * sd, 6) + 0.0 FROM st, range(0, 2) r(s)
UNION ALL SELECT st.vec_id, 'histogram', CAST(b AS INTEGER), round(lo + b * (hi - lo) / 8, 6) + 0.0, CAST(count(h.k) AS DOUBLE) FROM st CROSS JOIN range(0, 8) r(b) LEFT JOIN h ON h.vec_id = st.vec_id AND h.k = b GROUP BY st.vec_id, b, lo, hi""")
def diagnose_channel(spark, sf_dir):
    """The periodogram of the same call is that of welch_power."""
    d = S.diagnose_channel(signals(spark, sf_dir), ["vec_id"], FS, 16, 8, classes=8)
    return d.where("part <> 'periodogram'").select("vec_id", "part", "k", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("stacked_traces", f"""WITH {X}, g AS (SELECT DISTINCT vec_id, dense_rank() OVER (ORDER BY vec_id) - 1 AS k FROM x) SELECT vec_id, round(t / 64.0, 6) + 0.0 AS time FROM x JOIN g USING (vec_id)""")
def stacked_traces(spark, sf_dir):
    """Times of all points of a stacked plot; offsets come from an approximate quantile."""
    return S.plot_table(signals(spark, sf_dir), ["vec_id"], FS, max_points=None).select("vec_id", r6(F.col("time")).alias("time"))
