"""Volume queries: formula volumes of 8 x 8 x 8 voxels, one for each of four ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelwave.functions import mesh as K
from voxelwave.operators import mesh as M
from voxelwave.operators import volume as V
from voxelwave.plans.registry import query

N = 8
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
VOL = """vol AS (SELECT CAST(m AS BIGINT) AS vol_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST((i * 7 + j * 3 + k * 5 + m * i * j) % 11 AS DOUBLE) AS value
FROM range(0, 4) a(m), range(0, 8) b(i), range(0, 8) c(j), range(0, 8) d(k))"""
GRID = "g AS (SELECT CAST(m AS BIGINT) AS vol_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, 0.75 * i + 0.5 AS x, 0.5 * j + 0.25 * k - 0.25 AS y, k - 0.5 * i + 1.0 AS z FROM range(0, 4) a(m), range(0, 9) b(i), range(0, 10) c(j), range(0, 7) d(k))"
NEW = np.array([[0.75, 0, 0, 0.5], [0, 0.5, 0.25, -0.25], [-0.5, 0, 1, 1.0], [0, 0, 0, 1]])


def volumes(spark):
    c = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = spark.range(4).withColumnRenamed("id", "vol_id").select("vol_id", c(N).alias("i")).select("*", c(N).alias("j")).select("*", c(N).alias("k"))
    return d.withColumn("value", ((F.col("i") * 7 + F.col("j") * 3 + F.col("k") * 5 + F.col("vol_id") * F.col("i") * F.col("j")) % 11).cast("double"))


@query("volume_resample_nearest", f"WITH {VOL}, {GRID} SELECT g.vol_id, g.i, g.j, g.k, round(coalesce(v.value, -1.0), 6) + 0.0 AS value FROM g LEFT JOIN vol v ON v.vol_id = g.vol_id AND v.i = CAST(round_even(g.x, 0) AS INTEGER) AND v.j = CAST(round_even(g.y, 0) AS INTEGER) AND v.k = CAST(round_even(g.z, 0) AS INTEGER)")
def volume_resample_nearest(spark, sf_dir):
    return V.resample(volumes(spark), (N,) * 3, (9, 10, 7), np.eye(4), NEW, "nearest", -1.0).select("vol_id", "i", "j", "k", r6(F.col("value")).alias("value"))


def _taps(weights: dict[int, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT {d} AS d" for d in weights)
    w = lambda t: "CASE " + " ".join(f"WHEN {{d}} = {d} THEN {e.replace('T', t)}" for d, e in weights.items()) + " END"
    inside = " AND ".join(f"g.{c} >= 0 AND g.{c} <= 7" for c in "xyz")
    weight = " * ".join(f"({w(f'(g.{c} - floor(g.{c}))').format(d=f'{n}.d')})" for c, n in zip("xyz", ("da", "db", "dc")))
    at = " AND ".join(f"v.{a} = greatest(0, least(7, CAST(floor(g.{c}) AS INTEGER) + {n}.d))" for a, c, n in zip("ijk", "xyz", ("da", "db", "dc")))
    return f"""WITH {VOL}, {GRID}, d AS ({rows}), s AS (SELECT g.vol_id, g.i, g.j, g.k, sum({weight} * v.value) AS value FROM g CROSS JOIN d da CROSS JOIN d db CROSS JOIN d dc JOIN vol v ON v.vol_id = g.vol_id AND {at} WHERE {inside} GROUP BY ALL)
SELECT g.vol_id, g.i, g.j, g.k, round(coalesce(s.value, -1.0), 6) + 0.0 AS value FROM g LEFT JOIN s ON s.vol_id = g.vol_id AND s.i = g.i AND s.j = g.j AND s.k = g.k"""


@query("volume_resample_trilinear", _taps({0: "1 - T", 1: "T"}))
def volume_resample_trilinear(spark, sf_dir):
    return V.resample(volumes(spark), (N,) * 3, (9, 10, 7), np.eye(4), NEW, "trilinear", -1.0).select("vol_id", "i", "j", "k", r6(F.col("value")).alias("value"))


@query("volume_resample_cubic", _taps({-1: "((-0.5 * T + 1) * T - 0.5) * T", 0: "(1.5 * T - 2.5) * T * T + 1", 1: "((-1.5 * T + 2) * T + 0.5) * T", 2: "(0.5 * T - 0.5) * T * T"}))
def volume_resample_cubic(spark, sf_dir):
    return V.resample(volumes(spark), (N,) * 3, (9, 10, 7), np.eye(4), NEW, "bspline", -1.0).select("vol_id", "i", "j", "k", r6(F.col("value")).alias("value"))


@query("volume_transform", f"""WITH {VOL}, g AS (SELECT vol_id, i, j, k, 0.8 * i - 0.6 * j + 2.25 AS x, 0.6 * i + 0.8 * j - 1.5 AS y, k + 0.25 AS z FROM vol),
d AS (SELECT 0 AS d UNION ALL SELECT 1 AS d), s AS (SELECT g.vol_id, g.i, g.j, g.k, sum((CASE a.d WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE b.d WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE c.d WHEN 0 THEN 0.75 ELSE 0.25 END) * v.value) AS value
FROM (SELECT vol_id, i, j, k, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM g) g CROSS JOIN d a CROSS JOIN d b CROSS JOIN d c JOIN vol v ON v.vol_id = g.vol_id AND v.i = least(7, CAST(floor(x) AS INTEGER) + a.d) AND v.j = least(7, CAST(floor(y) AS INTEGER) + b.d) AND v.k = least(7, CAST(floor(z) AS INTEGER) + c.d)
WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7 GROUP BY ALL)
SELECT a.vol_id, a.i, a.j, a.k, round(coalesce(s.value, 0.0), 6) + 0.0 AS value FROM vol a LEFT JOIN s USING (vol_id, i, j, k)""")
def volume_transform(spark, sf_dir):
    """A turn by the angle of a 3-4-5 triangle and a move by fractions of voxels."""
    move = np.array([[0.8, -0.6, 0, 2.25], [0.6, 0.8, 0, -1.5], [0, 0, 1, 0.25], [0, 0, 0, 1]])
    return V.resample(volumes(spark), (N,) * 3, (N,) * 3, np.eye(4), np.eye(4), "trilinear", 0.0, move).select("vol_id", "i", "j", "k", r6(F.col("value")).alias("value"))


@query("grow_volume", f"""WITH {VOL}, s AS (SELECT * FROM vol WHERE value > 9) SELECT DISTINCT v.vol_id, v.i, v.j, v.k FROM vol v JOIN s ON s.vol_id = v.vol_id AND abs(s.i - v.i) <= 1 AND v.j - s.j BETWEEN 0 AND 1 AND abs(s.k - v.k) <= 1""")
def grow_volume(spark, sf_dir):
    return V.grow(volumes(spark).where("value > 9"), (N,) * 3, (3, 2, 3))


@query("volume_convolve_native", f"""WITH {VOL} SELECT a.vol_id, a.i, a.j, a.k, round(sum(b.value * (1 + abs(a.i - b.i) + 2 * abs(a.j - b.j) + 3 * abs(a.k - b.k))), 6) + 0.0 AS value FROM vol a JOIN vol b ON a.vol_id = b.vol_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL""")
def volume_convolve_native(spark, sf_dir):
    k = np.array([[[1 + abs(a) + 2 * abs(b) + 3 * abs(c) for c in (-1, 0, 1)] for b in (-1, 0, 1)] for a in (-1, 0, 1)], float)
    return V.convolve(volumes(spark), k).select("vol_id", "i", "j", "k", r6(F.col("value")).alias("value"))


# a vertex for each edge of the six tetrahedra of a cell that has one end inside
@query("isosurface", f"""WITH {VOL}, s AS (SELECT vol_id, i, j, k FROM vol WHERE value > 7), d AS (SELECT a * e AS a, b * e AS b, c * e AS c FROM (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)) q(a, b, c), (VALUES (1), (-1)) r(e))
SELECT vol_id AS mesh_id, CAST(0 AS BIGINT) AS boundary, CAST(0 AS BIGINT) AS non_manifold, count(*) AS vertices FROM s CROSS JOIN d ANTI JOIN s o ON o.vol_id = s.vol_id AND o.i = s.i + d.a AND o.j = s.j + d.b AND o.k = s.k + d.c GROUP BY vol_id""")
def isosurface(spark, sf_dir):
    v, f = M.isosurface_table(volumes(spark), (N,) * 3, None, 7.0)
    return M.edge_defects(f).join(v.groupBy("mesh_id").agg(F.count("*").alias("vertices")), "mesh_id")


# voxels that the surface crosses are inside
@query("fill_surface", "SELECT CAST(0 AS BIGINT) AS mesh_id, true AS near")
def fill_surface(spark, sf_dir):
    v, f = M.from_arrays(spark, {0: K.icosphere(3)})
    d = V.fill_surface(v, f, resolution=48)
    volume = F.count("*") * F.pow(F.max(F.get("vox2ras", F.lit(0))), 3)
    return d.groupBy("mesh_id").agg((F.abs(volume / (4 * np.pi / 3) - 1.08) < 0.12).alias("near"))


def _phantom(shift=(0.0, 0.0, 0.0), n: int = 20) -> np.ndarray:
    g = np.stack(np.meshgrid(*[np.arange(n, dtype=float)] * 3, indexing="ij"), -1)
    out = np.zeros((n, n, n))
    for c, w, a in (((8, 9, 10), 3.0, 1.0), ((13, 7, 11), 2.0, 0.7), ((9, 13, 7), 2.5, 0.5)):
        out += a * np.exp(-((g - np.array(c) - np.array(shift)) ** 2).sum(-1) / (2 * w * w))
    return out


def _pairs(spark):
    rows = [(k, _phantom().reshape(-1).tolist(), _phantom(s).reshape(-1).tolist()) for k, s in enumerate(((1.5, -1.0, 0.5), (-1.0, 0.5, 1.0)))]
    return spark.createDataFrame(rows, "pair_id long, fixed array<double>, moving array<double>").repartition(2)


for _kind in ("rigid", "affine", "syn"):

    @query(f"register_{_kind}", f"SELECT CAST(pair_id AS BIGINT) AS pair_id, '{_kind}' AS type, true AS near, true AS agrees FROM range(0, 2) r(pair_id)")
    def register(spark, sf_dir, kind=_kind):
        """Whether the known shift is found to a fifth of a voxel on each axis, and the volumes agree after it."""
        out = V.register(_pairs(spark), (20, 20, 20), kind, metric="meansquares", levels=((2, 1), (1, 0)), iterations=40, samples=4000, **({"syn_iterations": 6} if kind == "syn" else {}))
        shift = F.when(F.col("pair_id") == 0, F.array(*map(F.lit, (1.5, -1.0, 0.5)))).otherwise(F.array(*map(F.lit, (-1.0, 0.5, 1.0))))
        near = F.greatest(*(F.abs(F.get("transform", F.lit(i)) - F.get(shift, F.lit(k))) for k, i in enumerate((3, 7, 11)))) < 0.2
        return out.select("pair_id", "type", near.alias("near"), (F.col("correlation_after") > 0.98).alias("agrees"))


@query("register_in_ras", "SELECT CAST(k AS BIGINT) AS pair_id, true AS near, true AS agrees FROM range(0, 2) r(k)")
def register_in_ras(spark, sf_dir):
    """A moving volume on a finer, displaced grid of its own, a mask over the bodies, and landmarks in the second pair."""
    shift, n = np.array([1.0, -0.5, 0.75]), 24
    grid = np.array([[0.8, 0, 0, 1.0], [0, 0.8, 0, 2.0], [0, 0, 0.8, 1.5], [0, 0, 0, 1]])
    at = np.stack(np.meshgrid(*[np.arange(n, dtype=float)] * 3, indexing="ij"), -1) @ grid[:3, :3].T + grid[:3, 3]
    bodies = (((8, 9, 10), 3.0, 1.0), ((13, 7, 11), 2.0, 0.7), ((9, 13, 7), 2.5, 0.5))
    moving = sum(a * np.exp(-((at - np.array(c) - shift) ** 2).sum(-1) / (2 * w * w)) for c, w, a in bodies)
    fixed = _phantom()
    points = np.array([c for c, _, _ in bodies], float)
    rows = [(k, fixed.reshape(-1).tolist(), moving.reshape(-1).tolist(), np.eye(4).reshape(-1).tolist(), grid.reshape(-1).tolist(), (fixed > 0.02).astype(float).reshape(-1).tolist(), points.reshape(-1).tolist() if k else None, (points + shift).reshape(-1).tolist() if k else None) for k in range(2)]
    d = spark.createDataFrame(rows, "pair_id long, " + ", ".join(f"{c} array<double>" for c in ("fixed", "moving", "fixed_vox2ras", "moving_vox2ras", "mask", "fixed_points", "moving_points"))).repartition(2)
    out = V.register(d, (20, 20, 20), "rigid", (n,) * 3, metric="meansquares", levels=((2, 1), (1, 0)), iterations=40, samples=4000)
    far = F.greatest(*(F.abs(F.get("transform", F.lit(i)) - float(v)) for i, v in zip((3, 7, 11), shift)))
    return out.select("pair_id", (far < 0.25).alias("near"), (F.col("correlation_after") > 0.97).alias("agrees"))
