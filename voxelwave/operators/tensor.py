"""Tensor operators on long tables (one row a cell): baseline, marginals, shifts, covariance, quantiles, trends, runs.

All are Catalyst expressions, windows and pre-aggregated groupings; no Python worker is involved. NULL is a missing cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASELINE_METHODS = ("percentage", "sqrt_percentage", "decibel", "zscore", "sqrt_zscore", "db_zscore", "subtract_mean")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _log10(c: Column) -> Column:
    """log10, NULL where it is not defined."""
    return F.when(c > 0, F.log10(c))


def _baseline_stats(x: Column, inside: Column, method: str) -> dict[str, Column]:
    """Aggregates over the baseline cells of a unit, as expressions for a grouping or a window."""
    b = F.when(inside, x)
    n = F.sum(F.when(inside & x.isNotNull(), 1.0))
    if method in ("percentage", "subtract_mean"):
        return {"m": F.avg(b)}
    if method == "zscore":
        return {"m": F.avg(b), "s": F.stddev_samp(b)}
    if method == "sqrt_percentage":
        return {"m": F.avg(F.sqrt(b))}
    if method == "sqrt_zscore":
        return {"m": F.avg(F.sqrt(b)), "s": F.stddev_samp(F.sqrt(b))}
    # logarithms: cells of zero or less are skipped in sums, but count
    lg = _log10(b)
    out = {"m": F.coalesce(F.sum(lg), F.lit(0.0)) / n, "any": F.count(lg)}
    if method == "db_zscore":
        out |= {"sq": F.coalesce(F.sum(lg * lg), F.lit(0.0)), "n": n}
    return out


def _normalise(x: Column, s: dict[str, Column], method: str) -> Column:
    if method == "subtract_mean":
        return x - s["m"]
    if method == "percentage":
        return F.when(s["m"] != 0, (x / s["m"] - 1) * 100).otherwise(F.when(s["m"].isNotNull(), F.lit(0.0)))
    if method == "sqrt_percentage":
        return F.when(s["m"] != 0, (F.sqrt(x) / s["m"] - 1) * 100).otherwise(F.when(s["m"].isNotNull(), F.lit(0.0)))
    if method == "zscore":
        return F.when(s["s"] != 0, (x - s["m"]) / s["s"]).otherwise(F.when(s["s"].isNotNull(), F.lit(0.0)))
    if method == "sqrt_zscore":
        return F.when(s["s"] != 0, (F.sqrt(x) - s["m"]) / s["s"]).otherwise(F.when(s["s"].isNotNull(), F.lit(0.0)))
    if method == "decibel":
        return F.when(s["any"] > 0, 10 * (_log10(x) - s["m"])).otherwise(F.lit(0.0))
    var = (s["sq"] - s["n"] * s["m"] * s["m"]) / F.nullif(s["n"] - 1, F.lit(0.0))
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.when((s["any"] > 0) & (sd != 0), (_log10(x) - s["m"]) / sd).otherwise(F.lit(0.0))


def baseline(df: DataFrame, unit_dims: Sequence[str], inside: Column, method: str, value: str = "value", out: str = "value") -> DataFrame:
    """Normalise each cell by the baseline cells (``inside``) of its unit.

    The statistics are a pre-aggregated table of one row a unit, joined back; a unit of any size is never gathered in a task.
    """
    if method not in BASELINE_METHODS:
        raise ValueError(f"method must be one of {BASELINE_METHODS}")
    x = F.col(value).cast("double")
    stats = _baseline_stats(x, inside, method)
    named = {k: f"_b_{k}" for k in stats}
    units = df.groupBy(*unit_dims).agg(*(c.alias(named[k]) for k, c in stats.items()))
    joined = df.join(units, list(unit_dims)) if unit_dims else df.crossJoin(F.broadcast(units))
    made = _normalise(x, {k: F.col(c) for k, c in named.items()}, method)
    return joined.withColumn("_out", made).drop(*named.values(), *([value] if out == value else [])).withColumnRenamed("_out", out)


def baseline_from(df: DataFrame, base: DataFrame, unit_dims: Sequence[str], method: str, value: str = "value") -> DataFrame:
    """As :func:`baseline`, with the baseline cells in a table of their own."""
    tagged = df.withColumn("_inside", F.lit(False)).unionByName(base.withColumn("_inside", F.lit(True)), allowMissingColumns=True)
    return baseline(tagged, unit_dims, F.col("_inside"), method, value).where(~F.col("_inside")).drop("_inside")


TRANSFORMS = ("asis", "10log10", "square", "sqrt")


def _transform(x: Column, kind: str) -> Column:
    return {"asis": lambda: x, "10log10": lambda: 10 * _log10(x), "square": lambda: x * x, "sqrt": lambda: F.sqrt(x)}[kind]()


def collapse(df: DataFrame, keep: Sequence[str], how: str = "mean", transform: str = "asis", value: str = "value") -> DataFrame:
    """Marginal sums or means over all dimensions that are not kept. A mean divides by the cell count, missing cells included."""
    x = _transform(F.col(value).cast("double"), transform)
    total = F.sum(x)
    made = total if how == "sum" else total / F.count(F.lit(1))
    return df.groupBy(*keep).agg(made.alias(value))


def collapse_complex(df: DataFrame, keep: Sequence[str], how: str = "mean", transform: str = "asis", value: str = "value") -> DataFrame:
    """As :func:`collapse` for struct<re,im>: sums by part; the other transforms use the squared modulus."""
    re, im = F.col(f"{value}.re"), F.col(f"{value}.im")
    power = re * re + im * im
    if transform == "asis":
        parts = [F.sum(p) if how == "sum" else F.sum(p) / F.count(F.lit(1)) for p in (re, im)]
        return df.groupBy(*keep).agg(F.struct(parts[0].alias("re"), parts[1].alias("im")).alias(value))
    x = {"10log10": 10 * _log10(power), "square": power, "sqrt": F.sqrt(power)}[transform]
    return df.groupBy(*keep).agg((F.sum(x) if how == "sum" else F.sum(x) / F.count(F.lit(1))).alias(value))


def shift(df: DataFrame, shifts: DataFrame, units: Sequence[str], along: str, amount: str = "shift", value: str = "value") -> DataFrame:
    """y(t) = x(t + shift) by unit; NULL where that lies outside or the unit has no shift."""
    source = df.select(*units, F.col(along).alias("_t"), F.col(value).alias("_x"))
    grid = df.select(*units, along).join(shifts.select(*units, F.col(amount).alias("_s")), list(units), "left")
    source = source.withColumnRenamed("_t", "_at")
    return grid.withColumn("_at", F.col(along) + F.col("_s")).join(source, [*units, "_at"], "left").select(*units, along, F.col("_x").alias(value))


def covariance(df: DataFrame, row: str, col: str, value: str = "value", cols: Sequence[int] | None = None, other: DataFrame | None = None, other_cols: Sequence[int] | None = None, df_: float | None = None) -> DataFrame:
    """(c1, c2, cov) of the columns of one long matrix, or between those of two.

    Rows are first gathered into one array each (a row has as many cells as there are columns), and each row then gives its
    products; the sums are pre-aggregated map-side, so the shuffle holds one cell a column pair and task.
    """
    def rows(t: DataFrame, keep: Sequence[int] | None, name: str) -> DataFrame:
        t = t if keep is None else t.where(F.col(col).isin(list(keep)))
        return t.groupBy(row).agg(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).cast("double").alias("v"))).alias(name))

    a = rows(df, cols, "a")
    both = a.withColumn("b", F.col("a")) if other is None else a.join(rows(other, other_cols, "b"), row)
    pairs = both.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    g = pairs.groupBy(F.col("a.c").alias("c1"), F.col("b.c").alias("c2"))
    if df_ is None:
        return g.agg(F.covar_samp("a.v", "b.v").alias("cov"))
    return g.agg((F.covar_pop("a.v", "b.v") * F.count(F.lit(1)) / F.lit(float(df_))).alias("cov"))


#: Groups of up to so many rows are ranked whole; in larger ones only the rows around the quantile are.
RANKED_WHOLE = 100_000
ACCURACY = 10_000


def _ranked(df: DataFrame, by: Sequence[str], value: str, p: float, places: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, _n, _all, _q0, _q1, ...): exact order statistics near the quantile p; ``places`` are their ranks, from the count.

    A pre-aggregated sketch brackets the quantile: its ranks are wrong by one in ACCURACY at most, so two of them on either side
    hold the ranks of any group above RANKED_WHOLE. What lies below the bracket is only counted, what lies above is dropped, and
    equal values are one row each before the rest is sorted by group.
    """
    x = F.col(value).cast("double")
    edge = 2.0 / ACCURACY
    sketch = F.percentile_approx(x, [max(0.0, p - edge), min(1.0, p + edge)], ACCURACY)
    few = F.count(x) < RANKED_WHOLE
    low, high = F.when(few, F.min(x)).otherwise(sketch[0]), F.when(few, F.max(x)).otherwise(sketch[1])
    groups = df.groupBy(*by).agg(F.count(x).alias("_n"), F.count(F.lit(1)).alias("_all"), low.alias("_low"), high.alias("_high"))
    # the smallest key, null, is what lies below
    band = df.where(x.isNotNull()).select(*by, x.alias("_x")).join(groups, list(by)).where(F.col("_x") <= F.col("_high"))
    held = band.groupBy(*by, F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    w = W.partitionBy(*by).orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = held.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    ranks = places(F.col("_n"))
    picked = last.groupBy(*by).agg(*(F.max(F.when((r > F.col("_from")) & (r <= F.col("_to")), F.col("_x"))).alias(f"_q{k}") for k, r in enumerate(ranks)))
    return groups.select(*by, "_n", "_all").join(picked, list(by), "left")


def quantile(df: DataFrame, by: Sequence[str], p: float, value: str = "value", na_rm: bool = True) -> DataFrame:
    """The (n+1)p rule: an integer h gives that order statistic, else p * lower + (1 - p) * upper; ends are clamped."""
    h = lambda n: (n + 1) * F.lit(float(p))
    whole = lambda n: F.floor(h(n)) == h(n)
    lower = lambda n: F.greatest(F.lit(1), F.least(n, F.floor(h(n))))
    upper = lambda n: F.greatest(F.lit(1), F.least(n, F.when(whole(n), F.floor(h(n))).otherwise(F.floor(h(n)) + 1)))
    d = _ranked(df, by, value, p, lambda n: [lower(n), upper(n)])
    n, low, high = F.col("_n"), F.col("_q0"), F.col("_q1")
    mixed = F.when(whole(n) | (h(n) < 1), low).when(F.floor(h(n)) >= n, high).otherwise(p * low + (1 - p) * high)
    made = mixed if na_rm else F.when(n == F.col("_all"), mixed)
    return d.select(*by, made.alias(value))


def median(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """The middle value, or the mean of the two middle ones."""
    d = _ranked(df, by, value, 0.5, lambda n: [F.floor((n + 1) / 2), F.floor((n + 2) / 2)])
    return d.select(*by, ((F.col("_q0") + F.col("_q1")) / 2).alias(value))


def detrend_endpoint(df: DataFrame, by: Sequence[str], t: str, value: str = "value") -> DataFrame:
    """Subtract the line through the first and the last sample of each series."""
    x = F.col(value).cast("double")
    ends = df.groupBy(*by).agg(F.min_by(x, F.col(t)).alias("_a"), F.max_by(x, F.col(t)).alias("_b"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    slope = _ratio(F.col("_b") - F.col("_a"), (F.col("_t1") - F.col("_t0")).cast("double"))
    return df.join(ends, list(by)).select(*by, t, (x - (F.col("_a") + slope * (F.col(t) - F.col("_t0")))).alias(value))


def detrend(df: DataFrame, by: Sequence[str], t: str, trend: str = "linear", break_points: Sequence[int] | None = None, value: str = "value") -> DataFrame:
    """Remove each series' mean, its least-squares line, or the lines of the pieces between break points."""
    x, y = F.col(t).cast("double"), F.col(value).cast("double")
    if trend == "constant":
        fit = df.groupBy(*by).agg(F.avg(y).alias("_m"))
        return df.join(fit, list(by)).select(*by, t, (y - F.col("_m")).alias(value))
    piece = F.lit(0)
    for b in sorted(break_points or ()):
        piece = piece + (F.col(t) >= b).cast("int")
    tagged = df.withColumn("_piece", piece)
    fit = tagged.groupBy(*by, "_piece").agg(F.regr_slope(y, x).alias("_s"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    # centred first: the sum of mean and slope would round once more, at the size of the mean
    made = (y - F.col("_my")) - F.coalesce(F.col("_s"), F.lit(0.0)) * (x - F.col("_mx"))
    return tagged.join(fit, [*by, "_piece"]).select(*by, t, made.alias(value))


def islands(df: DataFrame, by: Sequence[str], index: str, max_lag: int = 1) -> DataFrame:
    """Runs of an integer set: (by, run_start, run_end); gaps of up to ``max_lag`` join."""
    w = W.partitionBy(*by).orderBy(index)
    gap = F.col(index) - F.lag(index).over(w)
    d = df.select(*by, index).distinct().withColumn("_new", F.when(gap.isNull() | (gap > max_lag), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return d.groupBy(*by, "_run").agg(F.min(index).alias("run_start"), F.max(index).alias("run_end")).drop("_run")


def run_text(df: DataFrame, by: Sequence[str], index: str, max_lag: int = 1, connect: str = "-", collapse_: str = ",") -> DataFrame:
    """Runs as text, such as 1-5,8."""
    piece = F.when(F.col("run_start") == F.col("run_end"), F.col("run_start").cast("string")).otherwise(F.concat_ws(connect, F.col("run_start"), F.col("run_end")))
    runs = islands(df, by, index, max_lag).withColumn("_p", F.struct(F.col("run_start"), piece.alias("p")))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda s: s["p"]), collapse_).alias("text"))


def parse_runs(df: DataFrame, text: str, out: str = "index", connect: str = "-", sep: str = ",") -> DataFrame:
    """Rows of the integers that a run text lists; blank and malformed pieces are skipped."""
    part = F.explode(F.split(F.col(text), sep)).alias("_p")
    d = df.select("*", part).withColumn("_e", F.split(F.regexp_replace(F.trim("_p"), r"\s", ""), connect))
    lo, hi = F.expr("try_cast(_e[0] AS int)"), F.expr("try_cast(_e[size(_e) - 1] AS int)")
    d = d.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    return d.select("*", F.explode(F.sequence("_lo", "_hi")).alias(out)).drop("_p", "_e", "_lo", "_hi")


def postpad(samples: Column, n: int) -> Column:
    """An array padded with zeros, or cut, to length n."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), n)), 1, n)


def guess_max_integer(validator, initial: int | None = None, low: int = 0, high: float = float("inf")) -> int | None:
    """The largest integer for which a predicate holds that is true up to some point: doubling, then bisection."""
    low = int(low)
    if not validator(low):
        return None
    good, step = low, 1
    if initial is not None and low < initial <= high and validator(int(initial)):
        good = int(initial)
    bad = None
    while bad is None:
        nxt = good + step
        if nxt > high:
            if validator(int(high)):
                return int(high)
            bad = int(high)
        elif validator(nxt):
            good, step = nxt, step * 2
        else:
            bad = nxt
    while bad - good > 1:
        mid = (good + bad) // 2
        if validator(mid):
            good = mid
        else:
            bad = mid
    return good


def long_to_arrays(df: DataFrame, by: Sequence[str], t: str, value: str = "value", out: str = "samples") -> DataFrame:
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(t), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias(out))


def arrays_to_long(df: DataFrame, by: Sequence[str], samples: str = "samples", t: str = "t", value: str = "value") -> DataFrame:
    return df.select(*by, F.posexplode(samples).alias(t, value))
