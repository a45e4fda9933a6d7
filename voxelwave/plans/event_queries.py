"""Event queries: values of events by user, and embeddings as short recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelwave.functions import sql
from voxelwave.operators import events as E
from voxelwave.plans.registry import ORACLES, query
from voxelwave.plans.signal_queries import signals, user_arrays
from voxelwave.plans.tensor_queries import SERIES, r6, series


_PEAKS = f"""{SERIES}, s AS (SELECT user_id, CASE WHEN min(value) >= 0 THEN min(value) ELSE median(value) END + stddev_samp(value) AS l, max(t) AS n FROM series GROUP BY user_id),
d AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT user_id, t, value FROM d JOIN s USING (user_id) WHERE (value - p) * (q - value) <= 0 AND q - value < value - p AND value > l)"""


@query("peak_candidates", f"WITH {_PEAKS} SELECT user_id, t, round(value, 6) + 0.0 AS value FROM c")
def peak_candidates(spark, sf_dir):
    return E.peak_candidates(series(spark, sf_dir), ["user_id"], "t").select("user_id", "t", r6(F.col("value")).alias("value"))


# highest first, each is kept unless a kept one is less than four samples away
@query("find_peaks", f"""WITH {_PEAKS}, o AS (SELECT user_id, list([t] ORDER BY value DESC, t) AS ts FROM c GROUP BY user_id),
k AS (SELECT user_id, unnest(list_reduce(ts, lambda kept, one: CASE WHEN len(list_filter(kept, lambda y: abs(y - one[1]) < 4)) = 0 THEN list_concat(kept, one) ELSE kept END)) AS t FROM o)
SELECT k.user_id, CAST(k.t AS INTEGER) AS "index", round(m.value, 6) + 0.0 AS value FROM k JOIN s USING (user_id) JOIN series m ON m.user_id = k.user_id AND m.t = k.t
JOIN series a ON a.user_id = k.user_id AND a.t = greatest(k.t - 2, 0) JOIN series b ON b.user_id = k.user_id AND b.t = least(k.t + 2, s.n) WHERE (b.value - m.value) * (m.value - a.value) <= 0""")
def find_peaks(spark, sf_dir):
    return E.find_peaks(user_arrays(spark, sf_dir), ["user_id"]).select("user_id", "index", r6(F.col("value")).alias("value"))


@query("stim_onsets", f"""WITH {SERIES}, d AS (SELECT user_id, t, abs(lead(value) OVER (PARTITION BY user_id ORDER BY t) - value) AS d FROM series),
h AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM d WHERE d > 40) SELECT user_id, t AS onset FROM h WHERE b IS NULL OR t - b > 3""")
def stim_onsets(spark, sf_dir):
    return E.stimpulse_onsets(series(spark, sf_dir), ["user_id"], "t", 40.0, 3)


@query("stim_extract", f"""WITH {SERIES}, d AS (SELECT user_id, t, abs(lead(value) OVER (PARTITION BY user_id ORDER BY t) - value) AS d FROM series),
h AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM d WHERE d > 40), o AS (SELECT user_id, t AS onset FROM h WHERE b IS NULL OR t - b > 3),
x AS (SELECT o.user_id, o.onset, CAST(k AS INTEGER) AS "offset", s.value FROM o CROSS JOIN range(-2, 5) r(k) LEFT JOIN series s ON s.user_id = o.user_id AND s.t = o.onset + k)
SELECT user_id, onset, "offset", round(value - median(value) OVER (PARTITION BY user_id, onset), 6) + 0.0 AS value FROM x""")
def stim_extract(spark, sf_dir):
    s = series(spark, sf_dir)
    d = E.stimpulse_extract(s, E.stimpulse_onsets(s, ["user_id"], "t", 40.0, 3), ["user_id"], "t", (-2, 4))
    return d.select("user_id", "onset", "offset", r6(F.col("value")).alias("value"))


# the first step over 40 opens a pulse, a step more than three samples after a pulse's first one opens the next
_PULSES = f"""{SERIES}, d AS (SELECT user_id, t, abs(lead(value) OVER (PARTITION BY user_id ORDER BY t) - value) AS d, max(t) OVER (PARTITION BY user_id) AS n FROM series),
o AS (SELECT user_id, unnest(list_reduce(list([t] ORDER BY t), lambda kept, one: CASE WHEN one[1] - kept[len(kept)] > 3 THEN list_concat(kept, one) ELSE kept END)) AS onset FROM d WHERE d > 40 GROUP BY user_id)"""


@query("stim_find", f"""WITH {_PULSES} SELECT o.user_id, CAST(onset AS INTEGER) AS onset, CAST(least(any_value(n), max(t) + 1) AS INTEGER) AS "offset" FROM o JOIN d ON d.user_id = o.user_id AND d.t BETWEEN onset AND onset + 5 AND d.d > 40 GROUP BY o.user_id, onset""")
def stim_find(spark, sf_dir):
    return E.stimpulse_find(user_arrays(spark, sf_dir), ["user_id"], 1.0, 3.0, threshold=40.0).select("user_id", "onset", "offset")


# the template is half way between the quartiles of all pulses; shifts are tried from the smallest on
@query("stim_align", f"""WITH {_PULSES}, w AS (SELECT o.user_id, o.onset, s, k, v.value FROM o CROSS JOIN (SELECT unnest([0, -1, 1, -2, 2, -3, 3]) AS s, unnest([0, 1, 2, 3, 4, 5, 6]) AS place) sh CROSS JOIN range(-4, 9) r(k) JOIN series v ON v.user_id = o.user_id AND v.t = o.onset + s + k),
p AS (SELECT user_id, onset, s, k, value - median(value) OVER (PARTITION BY user_id, onset, s) AS value FROM w),
te AS (SELECT user_id, k, (quantile_cont(value, 0.25) + quantile_cont(value, 0.75)) / 2 AS h FROM p WHERE s = 0 GROUP BY ALL),
sc AS (SELECT p.user_id, onset, s, avg(value * h) AS score FROM p JOIN te USING (user_id, k) GROUP BY ALL)
SELECT user_id, CAST(onset AS INTEGER) AS onset, CAST(onset + s AS INTEGER) AS aligned FROM sc QUALIFY row_number() OVER (PARTITION BY user_id, onset ORDER BY round(score, 9) DESC, abs(s), s) = 1""")
def stim_align(spark, sf_dir):
    return E.stimpulse_align(user_arrays(spark, sf_dir), ["user_id"], 1.0, 3.0, (-4, 8), threshold=40.0)


@query("stim_interpolate")
def stim_interpolate(spark, sf_dir):
    d = E.stimpulse_interpolate(user_arrays(spark, sf_dir), ["user_id"], 1.0, 3.0, threshold=40.0)
    return d.select("user_id", F.posexplode("samples").alias("t", "v")).select("user_id", "t", r6(F.col("v")).alias("value"))


@query("interpolate_stimulation")
def interpolate_stimulation(spark, sf_dir):
    d = E.interpolate_stimulation(user_arrays(spark, sf_dir), ["user_id"], 1.0, n_knots=12, duration=4.0)
    return d.select("user_id", F.posexplode("samples").alias("t", "v")).select("user_id", "t", r6(F.col("v")).alias("value"))


@query("smooth_signals")
def smooth_signals(spark, sf_dir):
    d = E.smooth_signals(signals(spark, sf_dir), ["vec_id"], 12)
    return d.select("vec_id", F.posexplode("samples").alias("t", "v")).select("vec_id", "t", r6(F.col("v")).alias("value"))


@query("find_outliers", f"""WITH {SERIES}, s AS (SELECT user_id, stddev_samp(value) AS sd FROM series GROUP BY user_id), h AS (SELECT user_id, t, value FROM series JOIN s USING (user_id) WHERE abs(value) > 1.5 * sd),
g AS (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM h) SELECT user_id, t, round(value, 6) + 0.0 AS value FROM g QUALIFY count(*) OVER (PARTITION BY user_id, g) >= 2""")
def find_outliers(spark, sf_dir):
    return E.find_outliers(series(spark, sf_dir), ["user_id"], "t", 1.5, 4, True).select("user_id", "t", r6(F.col("value")).alias("value"))


@query("spike_thresholds", f"WITH {SERIES} SELECT user_id, CAST(t // 20 AS BIGINT) AS segment, round(median(abs(value)) / 0.6745 * 5, 6) + 0.0 AS threshold FROM series GROUP BY ALL")
def spike_thresholds(spark, sf_dir):
    return E.spike_thresholds(series(spark, sf_dir), ["user_id"], "t", 20).select("user_id", "segment", r6(F.col("threshold")).alias("threshold"))


# one segment a series; a hit before the last spike is passed over, each spike is the least of four samples from its hit
@query("spike_detection", """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, median(abs(v)) / 0.6745 AS noise FROM x GROUP BY vec_id),
h AS (SELECT x.vec_id, x.t, arg_min(y.t, (y.v, y.t)) AS peak, arg_min(y.v, (y.v, y.t)) AS low, any_value(noise) AS noise FROM x JOIN m USING (vec_id) JOIN x y ON y.vec_id = x.vec_id AND y.t BETWEEN x.t AND x.t + 3 WHERE -x.v > 1.5 * noise AND x.t >= 4 AND x.t + 8 < 64 GROUP BY x.vec_id, x.t),
k AS (SELECT vec_id, any_value(noise) AS noise, list_reduce(list_prepend([-1], list([t, peak] ORDER BY t)), lambda kept, one: CASE WHEN one[1] >= kept[len(kept)] AND one[2] >= kept[len(kept)] THEN list_append(kept, one[2]) ELSE kept END) AS found FROM h WHERE abs(low) <= 50 * noise AND peak + 8 < 64 GROUP BY vec_id)
SELECT vec_id, CAST(unnest(found[2:]) AS INTEGER) AS "index", round(1.5 * noise, 6) + 0.0 AS threshold FROM k""")
def spike_detection(spark, sf_dir):
    return E.spike_detection(signals(spark, sf_dir), ["vec_id"], 64.0, std_min=1.5, w_pre=4, w_post=8, segment=1.0).select("vec_id", "index", r6(F.col("threshold")).alias("threshold"))


@query("spike_waveforms")
def spike_waveforms(spark, sf_dir):
    d = E.spike_waveforms(signals(spark, sf_dir), ["vec_id"], 64.0, 4, 8, std_min=1.5, segment=1.0)
    return d.select("vec_id", "spike", F.posexplode("waveform").alias("k", "v")).select("vec_id", "spike", "k", r6(F.col("v")).alias("value"))


@query("haar_coefficients", """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT * FROM (VALUES (1, 32), (2, 16), (3, 8), (4, 4)) q(l, base))
SELECT vec_id, CAST(base + t // CAST(pow(2, l) AS BIGINT) AS INTEGER) AS k, round(sum(CASE WHEN t % CAST(pow(2, l) AS BIGINT) < pow(2, l - 1) THEN v ELSE -v END) / pow(2, any_value(l) / 2.0), 6) + 0.0 AS value FROM x CROSS JOIN s GROUP BY vec_id, CAST(base + t // CAST(pow(2, l) AS BIGINT) AS INTEGER)
UNION ALL SELECT vec_id, CAST(t // 16 AS INTEGER) AS k, round(sum(v) / 4, 6) + 0.0 AS value FROM x GROUP BY ALL""")
def haar_coefficients(spark, sf_dir):
    d = E.haar_coefficients(signals(spark, sf_dir), ["vec_id"])
    return d.select("vec_id", F.posexplode("coefficients").alias("k", "v")).select("vec_id", "k", r6(F.col("v")).alias("value"))


_HAAR = """x AS (SELECT vec_id, label, unnest(range(0, 64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT * FROM (VALUES (1, 32), (2, 16), (3, 8), (4, 4)) q(l, base)),
c AS (SELECT vec_id, any_value(label) AS label, CAST(base + t // CAST(pow(2, l) AS BIGINT) AS INTEGER) AS k, sum(CASE WHEN t % CAST(pow(2, l) AS BIGINT) < pow(2, l - 1) THEN v ELSE -v END) / pow(2, any_value(l) / 2.0) AS v FROM x CROSS JOIN s GROUP BY vec_id, CAST(base + t // CAST(pow(2, l) AS BIGINT) AS INTEGER)
UNION ALL SELECT vec_id, any_value(label), CAST(t // 16 AS INTEGER) AS k, sum(v) / 4 FROM x GROUP BY vec_id, t // 16)"""


# the normal distribution by a series of positive terms
@query("haar_features", f"""WITH {_HAAR}, n1 AS (SELECT * FROM (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM c WINDOW w AS (PARTITION BY label, k)) WHERE coalesce(s, 0) = 0 OR abs(v - m) <= 3 * s),
n2 AS (SELECT label, k, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z, count(*) OVER w AS n, row_number() OVER (PARTITION BY label, k ORDER BY v) AS r FROM n1 WINDOW w AS (PARTITION BY label, k)),
p AS (SELECT label, k, n, r, CASE WHEN n >= 5 THEN 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(pow(z, 2 * j + 1) * exp(lgamma(j + 1) + j * ln(2) - lgamma(2 * j + 2))) FROM range(0, 60) q(j)) END AS p FROM n2),
d AS (SELECT label, k, coalesce(max(greatest(r / n::DOUBLE - p, p - (r - 1) / n::DOUBLE)), 0) AS d FROM p GROUP BY ALL)
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY d DESC, k) AS INTEGER) AS rank, k AS "column", round(d, 6) + 0.0 AS statistic FROM d""".replace("ln(2) - lgamma", "ln(2) - lgamma"))
def haar_features(spark, sf_dir):
    d = E.haar_features(signals(spark, sf_dir), ["label"], samples="samples")
    return d.select("label", "rank", "column", r6(F.col("statistic")).alias("statistic"))


@query("interpolate_missing", """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), g AS (SELECT vec_id, t, CASE WHEN t % 8 IN (3, 4) THEN NULL ELSE 2.0 * t + vec_id END AS v FROM x)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(2.0 * t + vec_id, 6) + 0.0 AS value FROM g""")
def interpolate_missing(spark, sf_dir):
    """A straight line with gaps: its natural spline is the line itself."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: F.when((t % 8).isin(3, 4), F.lit(float("nan"))).otherwise(2.0 * t + F.col("vec_id")))
    d = E.interpolate_missing(signals(spark, sf_dir).select("vec_id", gaps.alias("samples")), ["vec_id"])
    return d.select("vec_id", F.posexplode("samples").alias("t", "v")).select("vec_id", "t", r6(F.col("v")).alias("value"))


@query("sql_find_peaks", ORACLES["find_peaks"])
def sql_find_peaks(spark, sf_dir):
    """The table function in SQL."""
    sql.register(spark)
    d = user_arrays(spark, sf_dir)
    return spark.sql("SELECT d.user_id, p.index, round(p.value, 6) + 0.0D AS value FROM {d} d, LATERAL vw_find_peaks(d.samples) p", d=d)


@query("sql_envelope", ORACLES["hilbert_envelope"])
def sql_envelope(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT vec_id, t, round(v, 6) + 0.0D AS value FROM (SELECT vec_id, vw_envelope(samples) AS e FROM {d}) LATERAL VIEW posexplode(e) x AS t, v", d=signals(spark, sf_dir))
