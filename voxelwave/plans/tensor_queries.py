"""Tensor queries: monthly revenue by flag and status, event series by user, embedding columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.functions import colors
from voxelwave.functions import columns as C
from voxelwave.operators import tensor as T
from voxelwave.plans.registry import query
from voxelwave.runtime import table


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag x status x month, revenue in millions."""
    t = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", t.cast("int").alias("t"), "l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus", "t").agg((F.sum("l_extendedprice") / 1e6).alias("value"))


MONTHLY = """monthly AS (
  SELECT l_returnflag, l_linestatus, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, sum(l_extendedprice) / 1e6 AS value
  FROM lineitem GROUP BY ALL)"""


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


def m6(c) -> F.Column:
    """Six digits as DuckDB rounds doubles: the product by 10^6, not the shortest decimal text, decides what lies half way."""
    scaled = c * F.lit(1e6)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled, 0) / F.lit(1e6)).otherwise(c) + F.lit(0.0)


#: Added before rounding where values are exact decimals, so that none lies half way between two roundings.
NUDGE = "3.3e-8"


def n6(c) -> F.Column:
    return F.round(c + F.lit(float(NUDGE)), 6) + F.lit(0.0)


_STATS = {
    "percentage": ("avg(value) FILTER (t < 24)", "CASE WHEN m = 0 THEN 0 ELSE (value / m - 1) * 100 END"),
    "sqrt_percentage": ("avg(sqrt(value)) FILTER (t < 24)", "CASE WHEN m = 0 THEN 0 ELSE (sqrt(value) / m - 1) * 100 END"),
    "decibel": ("sum(log10(value)) FILTER (t < 24 AND value > 0) / count(value) FILTER (t < 24)", "CASE WHEN m IS NULL THEN 0 ELSE 10 * (log10(value) - m) END"),
    "zscore": ("avg(value) FILTER (t < 24)", "CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END"),
    "sqrt_zscore": ("avg(sqrt(value)) FILTER (t < 24)", "CASE WHEN s = 0 THEN 0 ELSE (sqrt(value) - m) / s END"),
    "db_zscore": ("avg(log10(value)) FILTER (t < 24)", "CASE WHEN s IS NULL OR s = 0 THEN 0 ELSE (log10(value) - m) / s END"),
    "subtract_mean": ("avg(value) FILTER (t < 24)", "value - m"),
}
_SD = {"zscore": "value", "sqrt_zscore": "sqrt(value)", "db_zscore": "log10(value)"}


def _baseline(method: str) -> None:
    m, out = _STATS[method]
    sd = f"stddev_samp({_SD.get(method, 'value')}) FILTER (t < 24)"
    sql = f"""WITH {MONTHLY}, b AS (SELECT l_returnflag, l_linestatus, {m} AS m, {sd} AS s FROM monthly GROUP BY ALL)
SELECT l_returnflag, l_linestatus, t, round({out}, 6) + 0.0 AS value FROM monthly JOIN b USING (l_returnflag, l_linestatus)"""

    @query(f"baseline_{method}", sql)
    def run(spark, sf_dir):
        return T.baseline(monthly(spark, sf_dir), ["l_returnflag", "l_linestatus"], F.col("t") < 24, method).select("l_returnflag", "l_linestatus", "t", r6(F.col("value")).alias("value"))


for _m in _STATS:
    _baseline(_m)

_SQL_TRANSFORM = {"asis": "value", "10log10": "10 * log10(value)", "square": "value * value", "sqrt": "sqrt(value)"}


def _collapse(transform: str, how: str) -> None:
    total = f"sum({_SQL_TRANSFORM[transform]})" + (" / count(*)" if how == "mean" else "")

    @query(f"collapse_{transform}_{how}", f"WITH {MONTHLY} SELECT l_returnflag, t, round({total}, 6) + 0.0 AS value FROM monthly GROUP BY ALL")
    def run(spark, sf_dir):
        return T.collapse(monthly(spark, sf_dir), ["l_returnflag", "t"], how, transform).select("l_returnflag", "t", r6(F.col("value")).alias("value"))


for _t in _SQL_TRANSFORM:
    for _h in ("sum", "mean"):
        _collapse(_t, _h)


@query("collapse_complex", f"""WITH {MONTHLY} SELECT l_returnflag, round(sum(value * cos(t)) / count(*), 6) + 0.0 AS re, round(sum(value * sin(t)) / count(*), 6) + 0.0 AS im,
round(sum(sqrt(value * cos(t) * value * cos(t) + value * sin(t) * value * sin(t))), 6) + 0.0 AS modulus FROM monthly GROUP BY ALL""")
def collapse_complex(spark, sf_dir):
    z = monthly(spark, sf_dir).withColumn("value", F.struct((F.col("value") * F.cos("t")).alias("re"), (F.col("value") * F.sin("t")).alias("im")))
    a = T.collapse_complex(z, ["l_returnflag"])
    b = T.collapse_complex(z, ["l_returnflag"], "sum", "sqrt").withColumnRenamed("value", "m")
    return a.join(b, "l_returnflag").select("l_returnflag", r6(F.col("value.re")).alias("re"), r6(F.col("value.im")).alias("im"), r6(F.col("m")).alias("modulus"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t, value: events of a user in order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("t"), "value")


SERIES = "series AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, value FROM events)"


@query("shift_align", f"""WITH {SERIES} SELECT a.user_id, a.t, round(b.value, 6) + 0.0 AS value FROM series a
LEFT JOIN series b ON a.user_id = b.user_id AND b.t = a.t + a.user_id % 7 - 3""")
def shift_align(spark, sf_dir):
    s = series(spark, sf_dir)
    shifts = s.select("user_id").distinct().withColumn("shift", (F.col("user_id") % 7 - 3).cast("int"))
    return T.shift(s, shifts, ["user_id"], "t").select("user_id", "t", r6(F.col("value")).alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, c, value) of all components."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "value"))


@query("cov_matrix", """WITH c AS (SELECT vec_id, unnest(range(0, len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT CAST(a.c AS INTEGER) AS c1, CAST(b.c AS INTEGER) AS c2, round(covar_samp(a.v, b.v), 9) + 0.0 AS cov FROM c a JOIN c b USING (vec_id) GROUP BY ALL""")
def cov_matrix(spark, sf_dir):
    return T.covariance(cells(spark, sf_dir), "vec_id", "c").select("c1", "c2", (F.round("cov", 9) + F.lit(0.0)).alias("cov"))


_Q1 = """SELECT {by}, round(CASE WHEN h = floor(h) OR floor(h) >= n OR h < 1 THEN s[CAST(least(greatest(floor(h), 1), n) AS BIGINT)]
ELSE {p} * s[CAST(floor(h) AS BIGINT)] + (1 - {p}) * s[CAST(floor(h) + 1 AS BIGINT)] END, 6) + 0.0 AS value
FROM (SELECT {by}, list_sort(list(CAST({v} AS DOUBLE))) AS s, count(*) AS n, (count(*) + 1) * {p} AS h FROM {t} GROUP BY {by})"""


@query("quantile_p25", _Q1.format(by="l_returnflag", p="0.25", v="l_extendedprice", t="lineitem"))
def quantile_p25(spark, sf_dir):
    return T.quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], 0.25, "l_extendedprice").select("l_returnflag", r6(F.col("l_extendedprice")).alias("value"))


@query("mv_quantile_p90", _Q1.format(by="c", p="0.9", v="v", t="(SELECT CAST(unnest(range(0, len(embedding))) AS INTEGER) AS c, unnest(embedding) AS v FROM embeddings)"))
def mv_quantile_p90(spark, sf_dir):
    return T.quantile(cells(spark, sf_dir), ["c"], 0.9).select("c", r6(F.col("value")).alias("value"))


@query("mv_median", "SELECT c, round(median(v), 6) + 0.0 AS value FROM (SELECT CAST(unnest(range(0, len(embedding))) AS INTEGER) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY c")
def mv_median(spark, sf_dir):
    return T.median(cells(spark, sf_dir), ["c"]).select("c", r6(F.col("value")).alias("value"))


@query("cov_between", """WITH c AS (SELECT vec_id, unnest(range(0, len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT CAST(a.c AS INTEGER) AS c1, CAST(b.c AS INTEGER) AS c2, round(covar_pop(a.v, 2 * b.v + b.c) * count(*) / 100, 9) + 0.0 AS cov FROM c a JOIN c b USING (vec_id) WHERE a.c IN (1, 5, 9) AND b.c IN (0, 5, 60) GROUP BY ALL""")
def cov_between(spark, sf_dir):
    """Column subsets of two matrices, and a divisor of one's own."""
    x = cells(spark, sf_dir)
    y = x.select("vec_id", "c", (2 * F.col("value").cast("double") + F.col("c")).alias("value"))
    return T.covariance(x, "vec_id", "c", cols=[1, 5, 9], other=y, other_cols=[0, 5, 60], df_=100).select("c1", "c2", (F.round("cov", 9) + F.lit(0.0)).alias("cov"))


@query("median", "SELECT l_returnflag, round(median(l_extendedprice), 6) + 0.0 AS value FROM lineitem GROUP BY ALL")
def median(spark, sf_dir):
    return T.median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", r6(F.col("l_extendedprice")).alias("value"))


@query("detrend_constant", f"WITH {SERIES} SELECT user_id, t, round(value - avg(value) OVER (PARTITION BY user_id) + {NUDGE}, 6) + 0.0 AS value FROM series")
def detrend_constant(spark, sf_dir):
    return T.detrend(series(spark, sf_dir), ["user_id"], "t", "constant").select("user_id", "t", n6(F.col("value")).alias("value"))


@query("detrend_linear", f"""WITH {SERIES}, f AS (SELECT user_id, regr_slope(value, t) AS s, avg(t) AS mt, avg(value) AS mv FROM series GROUP BY ALL)
SELECT user_id, t, round(value - mv - coalesce(s, 0) * (t - mt), 6) + 0.0 AS value FROM series JOIN f USING (user_id)""")
def detrend_linear(spark, sf_dir):
    return T.detrend(series(spark, sf_dir), ["user_id"], "t").select("user_id", "t", r6(F.col("value")).alias("value"))


@query("detrend_pieces", f"""WITH {SERIES}, p AS (SELECT *, CAST(t >= 20 AS INT) + CAST(t >= 45 AS INT) AS k FROM series),
f AS (SELECT user_id, k, regr_slope(value, t) AS s, avg(t) AS mt, avg(value) AS mv FROM p GROUP BY ALL)
SELECT user_id, t, round(value - mv - coalesce(s, 0) * (t - mt), 6) + 0.0 AS value FROM p JOIN f USING (user_id, k)""")
def detrend_pieces(spark, sf_dir):
    return T.detrend(series(spark, sf_dir), ["user_id"], "t", break_points=[20, 45]).select("user_id", "t", m6(F.col("value")).alias("value"))


@query("detrend_endpoint", f"""WITH {SERIES}, e AS (SELECT user_id, arg_min(value, t) AS a, arg_max(value, t) AS b, max(t) AS n FROM series GROUP BY ALL)
SELECT user_id, t, round(value - a - CASE WHEN n = 0 THEN 0 ELSE (b - a) / n * t END + {NUDGE}, 6) + 0.0 AS value FROM series JOIN e USING (user_id)""")
def detrend_endpoint(spark, sf_dir):
    return T.detrend_endpoint(series(spark, sf_dir), ["user_id"], "t").select("user_id", "t", n6(F.col("value")).alias("value"))


@query("island_runs", f"""WITH {SERIES}, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM series WHERE value > 50),
r AS (SELECT user_id, t, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM d)
SELECT user_id, min(t) AS run_start, max(t) AS run_end FROM r GROUP BY user_id, k""")
def island_runs(spark, sf_dir):
    return T.islands(series(spark, sf_dir).where("value > 50"), ["user_id"], "t", 2)


@query("run_text", f"""WITH {SERIES}, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM series WHERE value > 50),
r AS (SELECT user_id, t, sum(CASE WHEN g IS NULL OR g > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM d),
i AS (SELECT user_id, min(t) AS a, max(t) AS b FROM r GROUP BY user_id, k)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS text FROM i GROUP BY user_id""")
def run_text(spark, sf_dir):
    return T.run_text(series(spark, sf_dir).where("value > 50"), ["user_id"], "t")


@query("parse_runs", f"""WITH {SERIES} SELECT user_id, t AS "index" FROM series WHERE value > 50""")
def parse_runs(spark, sf_dir):
    return T.parse_runs(run_text(spark, sf_dir), "text").select("user_id", "index")


@query("postpad", """SELECT vec_id, CAST(unnest(range(0, 70)) AS INTEGER) AS i, round(unnest(list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0])), 6) + 0.0 AS value FROM embeddings WHERE len(embedding) = 64""")
def postpad(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return e.select("vec_id", F.posexplode(T.postpad(F.col("embedding").cast("array<double>"), 70)).alias("i", "v")).select("vec_id", "i", r6(F.col("v")).alias("value"))


def _cosine_sql(weights) -> str:
    return " ".join(f"{'+' if j % 2 == 0 else '-'} {w} * cos({j} * 2 * pi() * k / 31)" for j, w in enumerate(weights))


@query("window_tables", " UNION ALL ".join(f"SELECT '{n}' AS taper, CAST(k AS INTEGER) AS k, round({_cosine_sql(w)}, 9) + 0.0 AS value FROM range(0, 32) r(k)" for n, w in C.TAPER_WEIGHTS.items())
       + " UNION ALL SELECT 'bohmanwin' AS taper, CAST(k AS INTEGER) AS k, round(CASE WHEN k IN (0, 31) THEN 0 ELSE (1 - abs(2 * k / 31.0 - 1)) * cos(pi() * abs(2 * k / 31.0 - 1)) + sin(pi() * abs(2 * k / 31.0 - 1)) / pi() END, 9) + 0.0 AS value FROM range(0, 32) r(k)")
def window_tables(spark, sf_dir):
    names = [*C.TAPER_WEIGHTS, "bohmanwin"]
    grid = spark.range(0, 32).select(F.col("id").cast("int").alias("k"))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("taper"), C.taper(n, F.col("k"), 32).alias("value")) for n in names)))
    return grid.select("k", rows.alias("r")).select("r.taper", "k", (F.round("r.value", 9) + F.lit(0.0)).alias("value"))


@query("scalar_math", """SELECT vec_id, round(CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END, 9) + 0.0 AS sinc, round(greatest(-0.1, least(0.1, x)), 9) + 0.0 AS clamped,
round((2 * x + 3) * x - 1, 9) + 0.0 AS poly, round(21.4 * log10(1 + 0.00437 * abs(x) * 1000), 9) + 0.0 AS erb_scale, round(24.7 * (0.00437 * abs(x) * 1000 + 1), 9) + 0.0 AS erb
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)""")
def scalar_math(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    hz = F.abs("x") * 1000
    nine = lambda c: F.round(c, 9) + F.lit(0.0)
    return e.select("vec_id", nine(C.sinc(F.col("x"))).alias("sinc"), nine(C.clamp(F.col("x"), -0.1, 0.1)).alias("clamped"), nine(C.polyval([2, 3, -1], F.col("x"))).alias("poly"), nine(C.hertz_to_erb_scale(hz)).alias("erb_scale"), nine(C.hertz_to_erb(hz)).alias("erb"))


def _le(hex_: str, at: str, n: int) -> str:
    """The unsigned number in n bytes from byte ``at`` (0-based, an SQL expression), lowest byte first, as a HUGEINT."""
    digit = lambda place: f"CAST(strpos('0123456789abcdef', substr({hex_}, CAST({place} AS INTEGER), 1)) - 1 AS HUGEINT)"
    return "(" + " + ".join(f"({digit(f'2 * ({at} + {k}) + 1')} * 16 + {digit(f'2 * ({at} + {k}) + 2')}) * {256**k}::HUGEINT" for k in range(n)) + ")"


def _signed(v: str, bits: int) -> str:
    return f"CASE WHEN {v} >= {1 << bits - 1}::HUGEINT THEN {v} - {1 << bits}::HUGEINT ELSE {v} END"


def _decoded(name: str, n: int, count: int, value: str, kind: str) -> None:
    """Query raw_to_<name>: the 16 bytes of a digest as numbers of n bytes."""
    sql = f"""WITH b AS (SELECT part.p_partkey, md5(CAST(part.p_partkey AS VARCHAR)) AS h, CAST(unnest(range(0, {count})) AS INTEGER) AS i FROM part),
u AS (SELECT p_partkey, i, {_le('h', f'i * {n}', n)} AS u FROM b) SELECT p_partkey, i, {value} AS value FROM u"""

    @query(f"raw_to_{name}", sql)
    def run(spark, sf_dir):
        raw = F.unhex(F.md5(F.col("p_partkey").cast("string").cast("binary")))
        d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(getattr(C, f"raw_to_{name}")(raw)).alias("i", "value"))
        # a pattern of 255 exponent bits is no number
        v = F.col("value").cast(kind)
        return d.select("p_partkey", "i", (F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v) if name == "float" else v).alias("value"))


_decoded("uint8", 1, 16, "CAST(u AS INTEGER)", "int")
_decoded("int8", 1, 16, f"CAST({_signed('u', 8)} AS INTEGER)", "int")
_decoded("uint16", 2, 8, "CAST(u AS INTEGER)", "int")
_decoded("int16", 2, 8, f"CAST({_signed('u', 16)} AS INTEGER)", "int")
_decoded("uint32", 4, 4, "CAST(u AS BIGINT)", "long")
_decoded("int32", 4, 4, f"CAST({_signed('u', 32)} AS BIGINT)", "long")
_decoded("int64", 8, 2, f"CAST({_signed('u', 64)} AS BIGINT)", "long")
_decoded("float", 4, 4, """CASE WHEN u // 8388608 % 256 = 255 THEN NULL ELSE (CASE WHEN u >= 2147483648 THEN -1.0 ELSE 1.0 END) * CASE WHEN u // 8388608 % 256 = 0 THEN CAST(u % 8388608 AS DOUBLE) * pow(2.0, -149)
ELSE CAST(u % 8388608 + 8388608 AS DOUBLE) * pow(2.0, CAST(u // 8388608 % 256 AS DOUBLE) - 150) END END""", "double")


@query("raw_to_string", "SELECT p_partkey, p_name AS value FROM part")
def raw_to_string(spark, sf_dir):
    """Text up to the first zero byte."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", C.raw_to_string(F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("004142")))).alias("value"))


_PIECE = lambda c: f"CAST(floor(255 * least(16, greatest(0, 24 - abs(k - {c}))) / 16.0 + 0.5) AS INTEGER)"


@query("heat_palette", f"SELECT CAST(k AS INTEGER) AS k, '#' || " + " || ".join(f"printf('%02X', {_PIECE(c)})" for c in (47, 31, 15)) + " AS color FROM range(0, 64) r(k)")
def heat_palette(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(colors.heat_palette())), "k int, color string")


# from black over orange red to white
_MIX = lambda a, b, c: f"printf('%02X', CAST(floor(CASE WHEN p < 1 THEN {a} + ({b} - {a}) * p ELSE {b} + ({c} - {b}) * (p - 1) END + 0.5) AS INTEGER))"


@query("color_ramp", f"SELECT vec_id, '#' || {_MIX(0, 255, 255)} || {_MIX(0, 69, 255)} || {_MIX(0, 0, 255)} AS color FROM (SELECT vec_id, 2 * greatest(0, least(1, (CAST(embedding[1] AS DOUBLE) + 0.2) / 0.4)) AS p FROM embeddings)")
def color_ramp(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", colors.color_ramp(F.get("embedding", F.lit(0)).cast("double"), -0.2, 0.2, ["#000000", "#FF4500", "#FFFFFF"]).alias("color"))
