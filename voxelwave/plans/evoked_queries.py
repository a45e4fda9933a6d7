"""Evoked queries: embeddings as trials, their labels as channels, contacts or groups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.operators import evoked as E
from voxelwave.plans.registry import query
from voxelwave.plans.signal_queries import X, signals

r6 = lambda c: F.round(c, 6) + F.lit(0.0)


def trials(spark, sf_dir):
    """(ch, trial, t, value): every embedding is a trial of its label's channel."""
    w = W.partitionBy("label").orderBy("vec_id")
    s = signals(spark, sf_dir).withColumn("trial", (F.row_number().over(w) - 1).cast("int"))
    return s.select(F.col("label").cast("long").alias("ch"), "trial", F.posexplode("samples").alias("t", "value"))


@query("carla_rank", f"""WITH {X}, c AS (SELECT label AS ch, vec_id, t, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM x), p AS (SELECT ch, t, sum(c) AS s, sum(c * c) AS q, count(*) AS n FROM c GROUP BY ALL)
SELECT CAST(ch AS BIGINT) AS ch, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) / 63, 8) + 0.0 AS score FROM p GROUP BY ch""")
def carla_rank(spark, sf_dir):
    return E.trial_covariance(trials(spark, sf_dir)).select("ch", (F.round("score", 8) + F.lit(0.0)).alias("score"))


@query("carla")
def carla(spark, sf_dir):
    return E.carla(trials(spark, sf_dir).withColumn("rec", F.lit(0)), ["rec"]).select("ch", "rank", r6(F.col("score")).alias("score"), "chosen", "size")


# the window of strongest mean projection between different trials, and the t statistic over independent pairs in it
@query("crp", f"""WITH {X}, i AS (SELECT label, vec_id, t, v, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM x), en AS (SELECT unnest([5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 64]) AS e),
n AS (SELECT label, k, e, sqrt(sum(v * v)) AS n FROM i JOIN en ON t < e GROUP BY ALL), u AS (SELECT i.label, n.e, t, sum(v / n) AS u, sum(v) AS s FROM i JOIN n ON n.label = i.label AND n.k = i.k AND t < n.e GROUP BY ALL),
us AS (SELECT label, e, sum(u * s) AS us FROM u GROUP BY ALL), d AS (SELECT label, e, sum(n) AS d, count(*) AS m FROM n GROUP BY ALL),
b AS (SELECT label, e, m FROM us JOIN d USING (label, e) QUALIFY row_number() OVER (PARTITION BY label ORDER BY (us - d) / (m * (m - 1)) DESC, e) = 1),
p AS (SELECT a.label, a.k AS i, c.k AS j, sum(a.v * c.v) / any_value(n.n) AS p FROM b JOIN i a ON a.label = b.label AND a.t < b.e JOIN i c ON c.label = a.label AND c.t = a.t AND c.k <> a.k AND (a.k < c.k) = ((a.k + c.k) % 2 = 1) JOIN n ON n.label = a.label AND n.k = a.k AND n.e = b.e GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS ch, round((any_value(e) - 1) / 64.0, 6) + 0.0 AS tau, round(avg(p) / (stddev_samp(p) / sqrt(count(*))), 6) + 0.0 AS t_at_tau, CAST(any_value(m) AS INTEGER) AS n_trials, 1.0 AS shape_norm FROM p JOIN b USING (label) GROUP BY label""")
def crp(spark, sf_dir):
    d = trials(spark, sf_dir).withColumn("time", F.col("t") / 64.0)
    norm = F.aggregate("shape", F.lit(0.0), lambda a, v: a + v * v)
    return E.crp(d, ["ch"], start=0.0, end=1.0, remove=False).select("ch", *(r6(F.col(c)).alias(c) for c in ("tau", "t_at_tau")), "n_trials", r6(norm).alias("shape_norm"))


@query("crp_cluster")
def crp_cluster(spark, sf_dir):
    d = trials(spark, sf_dir).withColumn("time", F.col("t") / 64.0)
    return E.crp_cluster(spark, d, "ch", n=3, crp_options={"start": 0.0, "end": 1.0}).select("ch", "cluster", r6(F.col("fitness")).alias("fitness"))


@query("cosine_matrix", f"""WITH {X}, m AS (SELECT label, t, avg(v) AS v FROM x GROUP BY ALL)
SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) + 0.0 AS cosine FROM m a JOIN m b USING (t) GROUP BY ALL""")
def cosine_matrix(spark, sf_dir):
    from voxelwave.operators.tensor import long_to_arrays

    m = trials(spark, sf_dir).groupBy("ch", "t").agg(F.avg("value").alias("value"))
    return E.cosine_matrix(long_to_arrays(m, ["ch"], "t"), "ch").select("a", "b", r6(F.col("cosine")).alias("cosine"))


@query("bpc_xi", f"""WITH {X}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY ALL), p AS (SELECT a.label AS g1, b.label AS g2, a.vec_id AS i, b.vec_id AS j, sum(a.v / n.n * b.v) AS p FROM x a JOIN x b USING (t) JOIN n ON n.vec_id = a.vec_id WHERE a.vec_id <> b.vec_id GROUP BY ALL)
SELECT CAST(g1 AS BIGINT) AS g1, CAST(g2 AS BIGINT) AS g2, round(avg(p) / (stddev_samp(p) / sqrt(count(*))), 5) + 0.0 AS xi FROM p GROUP BY g1, g2""")
def bpc_xi(spark, sf_dir):
    return E.group_significance(signals(spark, sf_dir), "vec_id", "label").select("g1", "g2", (F.round("xi", 5) + F.lit(0.0)).alias("xi"))


@query("bpc")
def bpc(spark, sf_dir):
    d = trials(spark, sf_dir).withColumn("grp", F.col("ch")).withColumn("trial", F.col("ch") * (1 << 32) + F.col("trial")).withColumn("rec", F.lit(0))
    return E.bpc(d, ["rec"], n=3).select("grp", "curve", *(r6(F.col(c)).alias(c) for c in ("weight", "snr", "t", "p")))


@query("nmf")
def nmf(spark, sf_dir):
    m = trials(spark, sf_dir).groupBy("ch", "t").agg(F.abs(F.avg("value")).alias("value")).withColumn("rec", F.lit(0))
    return E.nmf(m, ["rec"], "ch", "t", 2, rounds=200).select("factor", "kind", "index", F.round("value", 4).alias("value"))
