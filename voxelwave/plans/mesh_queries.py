"""Mesh queries: four parametric tori of growing size (24 x 12 cells), and points from embeddings."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from voxelwave.functions import mesh as K
from voxelwave.operators import mesh as M
from voxelwave.plans.registry import query
from voxelwave.runtime import cut, table

NU, NV, MESHES = 24, 12, 4
r6 = lambda c: F.round(c, 6) + F.lit(0.0)

V = f"""v AS (SELECT CAST(m AS BIGINT) AS mesh_id, CAST(i * {NV} + j AS INTEGER) AS vid, (m + 1) * (3 + cos(2 * pi() * j / {NV})) * cos(2 * pi() * i / {NU}) AS x,
(m + 1) * (3 + cos(2 * pi() * j / {NV})) * sin(2 * pi() * i / {NU}) AS y, (m + 1) * sin(2 * pi() * j / {NV}) AS z FROM range(0, {MESHES}) a(m), range(0, {NU}) b(i), range(0, {NV}) c(j))"""
FACES = f"""q AS (SELECT CAST(m AS BIGINT) AS mesh_id, i * {NV} + j AS q, i * {NV} + j AS a, (i + 1) % {NU} * {NV} + j AS b, (i + 1) % {NU} * {NV} + (j + 1) % {NV} AS c, i * {NV} + (j + 1) % {NV} AS d FROM range(0, {MESHES}) a(m), range(0, {NU}) b(i), range(0, {NV}) c(j)),
f AS (SELECT mesh_id, CAST(2 * q AS INTEGER) AS fid, CAST(a AS INTEGER) AS v0, CAST(b AS INTEGER) AS v1, CAST(c AS INTEGER) AS v2 FROM q UNION ALL SELECT mesh_id, CAST(2 * q + 1 AS INTEGER), CAST(a AS INTEGER), CAST(c AS INTEGER), CAST(d AS INTEGER) FROM q)"""
GEN = f"WITH {V}, {FACES}"
T = f"""{GEN}, t AS (SELECT f.mesh_id, f.fid, f.v0, f.v1, f.v2, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM f
JOIN v p ON p.mesh_id = f.mesh_id AND p.vid = f.v0 JOIN v q ON q.mesh_id = f.mesh_id AND q.vid = f.v1 JOIN v r ON r.mesh_id = f.mesh_id AND r.vid = f.v2),
h AS (SELECT mesh_id, v0 AS a, v1 AS b, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)) AS d FROM t UNION ALL SELECT mesh_id, v1, v2, sqrt(pow(cx - bx, 2) + pow(cy - by_, 2) + pow(cz - bz, 2)) FROM t
UNION ALL SELECT mesh_id, v2, v0, sqrt(pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)) FROM t)"""


def torus(spark):
    grid = spark.range(MESHES).select(F.col("id").alias("mesh_id"), F.explode(F.sequence(F.lit(0), F.lit(NU * NV - 1))).alias("vid"))
    i, j = F.floor(F.col("vid") / NV), F.col("vid") % NV
    u, w, s = 2 * F.pi() * i / NU, 2 * F.pi() * j / NV, F.col("mesh_id") + 1
    v = grid.select("mesh_id", "vid", (s * (3 + F.cos(w)) * F.cos(u)).alias("x"), (s * (3 + F.cos(w)) * F.sin(u)).alias("y"), (s * F.sin(w)).alias("z"))
    b, d = ((i + 1) % NU * NV + j).cast("int"), (i * NV + (j + 1) % NV).cast("int")
    c = ((i + 1) % NU * NV + (j + 1) % NV).cast("int")
    tris = F.array(F.struct((2 * F.col("vid")).alias("fid"), F.col("vid").alias("v0"), b.alias("v1"), c.alias("v2")), F.struct((2 * F.col("vid") + 1).alias("fid"), F.col("vid").alias("v0"), c.alias("v1"), d.alias("v2")))
    return v, grid.select("mesh_id", F.explode(tris).alias("t")).select("mesh_id", "t.*")


@query("mesh_volume", f"{T} SELECT mesh_id, round(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 6) + 0.0 AS volume FROM t GROUP BY mesh_id")
def mesh_volume(spark, sf_dir):
    return M.volume(*torus(spark)).select("mesh_id", r6(F.col("volume")).alias("volume"))


@query("mesh_edge_lengths", f"{T} SELECT mesh_id, round(avg(d), 6) + 0.0 AS mean_edge, round(max(d), 6) + 0.0 AS max_edge FROM h GROUP BY mesh_id")
def mesh_edge_lengths(spark, sf_dir):
    return M.edge_lengths(*torus(spark)).select("mesh_id", r6(F.col("mean_edge")).alias("mean_edge"), r6(F.col("max_edge")).alias("max_edge"))


@query("mesh_edge_defects", f"""{T}, o AS (SELECT mesh_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM h WHERE NOT (a < 24 AND b < 24) GROUP BY ALL)
SELECT mesh_id, count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n > 2) AS non_manifold FROM (SELECT mesh_id, least(a, b), greatest(a, b), count(*) AS n FROM (
SELECT f.mesh_id, unnest([f.v0, f.v1, f.v2]) AS a, unnest([f.v1, f.v2, f.v0]) AS b FROM f WHERE fid >= 40) GROUP BY ALL) GROUP BY mesh_id""")
def mesh_edge_defects(spark, sf_dir):
    return M.edge_defects(torus(spark)[1].where("fid >= 40"))


def _normals_sql(weight: str) -> str:
    n = "(by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz"
    if weight == "area":
        rows = "SELECT mesh_id, unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM n"
    else:
        ang = lambda p, q, r: f"acos(greatest(-1, least(1, (({q}x - {p}x) * ({r}x - {p}x) + ({q}y - {p}y) * ({r}y - {p}y) + ({q}z - {p}z) * ({r}z - {p}z)) / sqrt((pow({q}x - {p}x, 2) + pow({q}y - {p}y, 2) + pow({q}z - {p}z, 2)) * (pow({r}x - {p}x, 2) + pow({r}y - {p}y, 2) + pow({r}z - {p}z, 2))))))"
        rows = f"SELECT mesh_id, vid, nx * w / l AS nx, ny * w / l AS ny, nz * w / l AS nz FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, unnest([{ang('a', 'b', 'c')}, {ang('b', 'c', 'a')}, {ang('c', 'a', 'b')}]) AS w, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n)"
    rows = re.sub(r"\bby\b", "by_", rows)
    return f"""{T}, n AS (SELECT *, {n} FROM t), s AS (SELECT mesh_id, vid, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM ({rows}) GROUP BY ALL)
SELECT mesh_id, vid, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS ny, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS nz FROM s"""


for _w in ("area", "angle"):

    @query(f"vertex_normals_{_w}", _normals_sql(_w))
    def vertex_normals(spark, sf_dir, w=_w):
        return M.update_normals(*torus(spark), w).select("mesh_id", "vid", *(r6(F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"))


@query("mesh_subset", f"{GEN} SELECT mesh_id, v0 - 36 AS v0, v1 - 36 AS v1, v2 - 36 AS v2 FROM f WHERE v0 >= 36 AND v1 >= 36 AND v2 >= 36")
def mesh_subset(spark, sf_dir):
    """Faces of the part, with its vertices numbered anew."""
    return M.subset_vertices(*torus(spark), F.col("vid") >= 36)[1].select("mesh_id", "v0", "v1", "v2")


@query("mesh_subset_vertices", f"{GEN} SELECT mesh_id, vid - 36 AS vid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM v WHERE vid >= 36")
def mesh_subset_vertices(spark, sf_dir):
    return M.subset_vertices(*torus(spark), F.col("vid") >= 36)[0].select("mesh_id", "vid", *(r6(F.col(c)).alias(c) for c in "xyz"))


def _triangles(v, f):
    """Middle and area of each face."""
    from voxelwave.functions import geometry as G

    c = M.corners(v, f)
    area = G.length(G.cross(G.sub(F.col("p1"), F.col("p0")), G.sub(F.col("p2"), F.col("p0")))) / 2
    return c.select("mesh_id", *(r6((F.col(f"p0.{a}") + F.col(f"p1.{a}") + F.col(f"p2.{a}")) / 3).alias(a) for a in "xyz"), r6(area).alias("area"))


def _parts(*faces: str) -> str:
    """Faces over the corners a, b, c, the middles ab, bc, ca of edges and m of the face, by the letters of their points."""
    at = {"a": ["a{}"], "b": ["b{}"], "c": ["c{}"], "ab": ["a{}", "b{}"], "bc": ["b{}", "c{}"], "ca": ["c{}", "a{}"], "m": ["a{}", "b{}", "c{}"]}
    col = lambda p, x: "(" + " + ".join((c.format(x) + ("_" if c == "b{}" and x == "y" else "")) for c in at[p]) + f") / {len(at[p])}"
    rows = " UNION ALL ".join("SELECT mesh_id, " + ", ".join(f"{col(p, x)} AS {n}{x}" for n, p in zip("pqr", face.split())  for x in "xyz") + " FROM t" for face in faces)
    cross = "pow((qy - py) * (rz - pz) - (qz - pz) * (ry - py), 2) + pow((qz - pz) * (rx - px) - (qx - px) * (rz - pz), 2) + pow((qx - px) * (ry - py) - (qy - py) * (rx - px), 2)"
    return f"{T}, parts AS ({rows}) SELECT mesh_id, round((px + qx + rx) / 3, 6) + 0.0 AS x, round((py + qy + ry) / 3, 6) + 0.0 AS y, round((pz + qz + rz) / 3, 6) + 0.0 AS z, round(sqrt({cross}) / 2, 6) + 0.0 AS area FROM parts"


@query("mesh_subdivide_edge", _parts("a ab ca", "ab b bc", "ca bc c", "ab bc ca"))
def mesh_subdivide_edge(spark, sf_dir):
    """Middle and area of every face of the subdivided mesh."""
    return _triangles(*M.subdivide(*torus(spark)))


@query("mesh_subdivide_edge_vertices", f"""{T}, e AS (SELECT DISTINCT mesh_id, least(a, b) AS a, greatest(a, b) AS b FROM h)
SELECT mesh_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM (SELECT mesh_id, x, y, z FROM v UNION ALL SELECT e.mesh_id, (p.x + q.x) / 2, (p.y + q.y) / 2, (p.z + q.z) / 2 FROM e
JOIN v p ON p.mesh_id = e.mesh_id AND p.vid = e.a JOIN v q ON q.mesh_id = e.mesh_id AND q.vid = e.b)""")
def mesh_subdivide_edge_vertices(spark, sf_dir):
    return M.subdivide(*torus(spark))[0].select("mesh_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("mesh_subdivide_barycenter", _parts("a b m", "b c m", "c a m"))
def mesh_subdivide_barycenter(spark, sf_dir):
    return _triangles(*M.subdivide(*torus(spark), "barycenter"))


@query("mesh_smooth_average", f"""{T}, e AS (SELECT DISTINCT mesh_id, a, b FROM (SELECT mesh_id, a, b FROM h UNION ALL SELECT mesh_id, b, a FROM h UNION ALL SELECT mesh_id, vid, vid FROM v)),
s1 AS (SELECT e.mesh_id, e.a AS vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e JOIN v ON v.mesh_id = e.mesh_id AND v.vid = e.b GROUP BY ALL),
s2 AS (SELECT e.mesh_id, e.a AS vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e JOIN s1 ON s1.mesh_id = e.mesh_id AND s1.vid = e.b GROUP BY ALL)
SELECT mesh_id, vid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM s2""")
def mesh_smooth_average(spark, sf_dir):
    return M.smooth_average(*torus(spark), iterations=2).select("mesh_id", "vid", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("geodesic_distance", """WITH RECURSIVE p AS (SELECT i * 8 + j AS vid, i, j FROM range(0, 8) a(i), range(0, 8) b(j)),
g AS (SELECT vid, CAST(1.0 * greatest(i, j) + (sqrt(2) - 1) * 0 AS DOUBLE) AS unused, i, j FROM p)
SELECT CAST(vid AS INTEGER) AS vid, round(abs(i - j) + sqrt(2) * least(i, j), 6) + 0.0 AS distance FROM g""")
def geodesic_distance(spark, sf_dir):
    """An 8 x 8 plane whose cells are cut along the diagonal from the start corner: straight steps and those diagonals."""
    vs, fs = K.plane(7, 7, (8, 8))
    v, f = M.from_arrays(spark, {0: (vs, fs)})
    return M.geodesic(v, f, 0).select("vid", r6(F.col("distance")).alias("distance"))


@query("ray_hits", """SELECT vec_id AS ray_id, CASE WHEN abs(x) < 1 AND abs(y) < 1 THEN 4.0 END AS distance, CASE WHEN abs(x) < 1 AND abs(y) < 1 THEN round(x, 6) + 0.0 END AS px, CASE WHEN abs(x) < 1 AND abs(y) < 1 THEN round(y, 6) + 0.0 END AS py
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 5 AS x, CAST(embedding[2] AS DOUBLE) * 5 AS y FROM embeddings)""")
def ray_hits(spark, sf_dir):
    cube = np.array([[x, y, z] for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)])
    f = np.array([[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]])
    v, faces = M.from_arrays(spark, {0: (cube, f)})
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("mesh_id"), F.col("vec_id").alias("ray_id"), (F.get("embedding", F.lit(0)).cast("double") * 5).alias("ox"), (F.get("embedding", F.lit(1)).cast("double") * 5).alias("oy"), F.lit(5.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-2.0).alias("dz"))
    return M.raycast(v, faces, e, normals=False).select("ray_id", r6(F.col("distance")).alias("distance"), r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


_POINTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(embedding[3] AS FLOAT) AS z FROM embeddings)"


@query("knn_3", f"""WITH {_POINTS}, d AS (SELECT a.id AS query_id, b.id AS target_id, CAST((a.x - b.x) * (a.x - b.x) AS FLOAT) + CAST((a.y - b.y) * (a.y - b.y) AS FLOAT) + CAST((a.z - b.z) * (a.z - b.z) AS FLOAT) AS d FROM p a CROSS JOIN p b)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, target_id FROM d WINDOW w AS (PARTITION BY query_id ORDER BY d, target_id) QUALIFY row_number() OVER w <= 3""")
def knn_3(spark, sf_dir):
    """The three nearest of every point."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    return M.knn(p, p, 3, block=1 << 14).select("query_id", "rank", "target_id")


@query("mesh_curvature")
def mesh_curvature(spark, sf_dir):
    return M.mris_curvature(*torus(spark)).select("mesh_id", "vid", *(r6(F.col(c)).alias(c) for c in ("k1", "k2", "mean", "gauss")))


@query("mesh_curvature_sphere", "SELECT CAST(m AS BIGINT) AS mesh_id, CAST(k AS INTEGER) AS vid, true AS gauss, true AS mean FROM range(0, 2) r(m), range(0, 642) q(k)")
def mesh_curvature_sphere(spark, sf_dir):
    """Whether curvatures of spheres of radius 1 and 2 are within a twentieth of their inverse radius, by every vertex."""
    c = M.mris_curvature(*M.from_arrays(spark, {m: (K.icosphere(3)[0] * (m + 1), K.icosphere(3)[1]) for m in range(2)}))
    r = F.col("mesh_id") + 1
    return c.select("mesh_id", "vid", (F.abs(F.col("gauss") * r * r - 1) < 0.05).alias("gauss"), (F.abs(F.col("mean") * r - 1) < 0.05).alias("mean"))


def _chain(kind: str, rounds: int = 3) -> str:
    """Smoothing by chained tables s0, s1, ..., each over the neighbours or faces of the last."""
    ctes = ["e AS MATERIALIZED (SELECT DISTINCT mesh_id, a, b FROM (SELECT mesh_id, a, b FROM h UNION ALL SELECT mesh_id, b, a FROM h))", "s0 AS MATERIALIZED (SELECT mesh_id, vid, x, y, z FROM v)"]
    xyz = lambda form: ", ".join(f"{form.replace('#', c)} AS {c}" for c in "xyz")
    mean = lambda src: f"SELECT e.mesh_id, e.a AS vid, {xyz('avg(p.#)')} FROM e JOIN {src} p ON p.mesh_id = e.mesh_id AND p.vid = e.b GROUP BY ALL"
    n = 0

    def add(sql: str) -> str:
        nonlocal n
        n += 1
        ctes.append(f"s{n} AS MATERIALIZED ({sql})")
        return f"s{n}"

    now = "s0"
    moved = lambda src, mid, form: add(f"SELECT mesh_id, v.vid, {xyz(form)} FROM {src} v JOIN {mid} m USING (mesh_id, vid)")
    corners = lambda src: f"SELECT f.mesh_id, f.v0, f.v1, f.v2, {', '.join(f'{p}.{c} AS {p}{c}' for p in 'jkl' for c in 'xyz')} FROM f JOIN {src} j ON j.mesh_id = f.mesh_id AND j.vid = f.v0 JOIN {src} k ON k.mesh_id = f.mesh_id AND k.vid = f.v1 JOIN {src} l ON l.mesh_id = f.mesh_id AND l.vid = f.v2"
    normal = "(ky - jy) * (lz - jz) - (kz - jz) * (ly - jy) AS nx, (kz - jz) * (lx - jx) - (kx - jx) * (lz - jz) AS ny, (kx - jx) * (ly - jy) - (ky - jy) * (lx - jx) AS nz"
    for _ in range(rounds):
        if kind == "laplace":
            now = add(f"SELECT mesh_id, vid, {xyz('avg(#)')} FROM (SELECT e.mesh_id, e.a AS vid, p.x, p.y, p.z FROM e JOIN {now} p ON p.mesh_id = e.mesh_id AND p.vid = e.b UNION ALL SELECT mesh_id, vid, x, y, z FROM {now}) GROUP BY ALL")
        elif kind == "taubin":
            for w in (0.5, -0.53):
                now = moved(now, add(mean(now)), f"v.# + {w} * (m.# - v.#)")
        elif kind == "HClaplace":
            q = add(mean(now))
            b_ = moved(now, q, "m.# - v.#")
            half = moved(b_, add(mean(b_)), "0.5 * v.# + 0.5 * m.#")
            now = moved(q, half, "v.# - m.#")
        elif kind == "fujiLaplace":
            near = add(f"SELECT mesh_id, vid, {xyz('sum(w * #) / sum(w)')} FROM (SELECT e.mesh_id, e.a AS vid, q.x, q.y, q.z, 1 / sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS w FROM e JOIN {now} p ON p.mesh_id = e.mesh_id AND p.vid = e.a JOIN {now} q ON q.mesh_id = e.mesh_id AND q.vid = e.b) GROUP BY ALL")
            now = moved(now, near, "v.# + 0.1 * (m.# - v.#)")
        elif kind == "angWeight":
            dot = lambda o, p, q: "(" + " + ".join(f"({p}{c} - {o}{c}) * ({q}{c} - {o}{c})" for c in "xyz") + ")"
            angle = lambda o, p, q: f"acos(greatest(-1, least(1, {dot(o, p, q)} / sqrt({dot(o, p, p)} * {dot(o, q, q)}))))"
            mid = add(f"SELECT mesh_id, vid, {xyz('sum(w * #) / sum(w)')} FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, unnest([{angle('j', 'k', 'l')}, {angle('k', 'l', 'j')}, {angle('l', 'j', 'k')}]) AS w, {xyz('(j# + k# + l#) / 3')} FROM ({corners(now)})) GROUP BY ALL")
            now = moved(now, mid, "v.# + 0.5 * (m.# - v.#)")
        elif kind == "surfPreserveLaplace":
            unit = add(f"SELECT mesh_id, vid, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM (SELECT *, {normal} FROM ({corners(now)}))) GROUP BY ALL")
            unit = add(f"SELECT mesh_id, vid, {xyz('# / sqrt(x * x + y * y + z * z)')} FROM {unit}".replace("x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y", "x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y"))
            step = moved(now, add(mean(now)), "m.# - v.#")
            along = add(f"SELECT mesh_id, s.vid, s.x * n.x + s.y * n.y + s.z * n.z AS d FROM {step} s JOIN {unit} n USING (mesh_id, vid)")
            now = add(f"SELECT mesh_id, v.vid, {xyz('v.# + 0.5 * (s.# - n.# * a.d)')} FROM {now} v JOIN {step} s USING (mesh_id, vid) JOIN {unit} n USING (mesh_id, vid) JOIN {along} a USING (mesh_id, vid)")
    return f"{T}, {', '.join(ctes)} SELECT mesh_id, vid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM {now}"


for _k in ("taubin", "laplace", "HClaplace", "fujiLaplace", "angWeight", "surfPreserveLaplace"):

    @query(f"mesh_smooth_{_k}", _chain(_k))
    def mesh_smooth(spark, sf_dir, k=_k):
        return M.smooth_explicit(*torus(spark), k, iterations=3).select("mesh_id", "vid", *(r6(F.col(c)).alias(c) for c in "xyz"))


def _residual() -> str:
    """The linear system whose solution the implicit step is: mass is a third of the faces around, over its mean."""
    area = "sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) / 2"
    return f"""{T}, ma AS (SELECT mesh_id, unnest([v0, v1, v2]) AS vid, {area} / 3 AS w FROM t), mb AS (SELECT mesh_id, vid, sum(w) AS w FROM ma GROUP BY ALL)
SELECT mesh_id, vid, round(w / avg(w) OVER (PARTITION BY mesh_id) * x, 6) + 0.0 AS x, round(w / avg(w) OVER (PARTITION BY mesh_id) * y, 6) + 0.0 AS y, round(w / avg(w) OVER (PARTITION BY mesh_id) * z, 6) + 0.0 AS z FROM mb JOIN v USING (mesh_id, vid)"""


@query("mesh_smooth_implicit", _residual())
def mesh_smooth_implicit(spark, sf_dir):
    """The solution put back into its system, by joins: mass times solution and a fifth of its Laplacian give mass times the start."""
    v, f = torus(spark)
    x = cut(M.smooth_implicit(v, f), "smooth")
    c = M.corners(v, f)
    from voxelwave.functions import geometry as G

    area = G.length(G.cross(G.sub(F.col("p1"), F.col("p0")), G.sub(F.col("p2"), F.col("p0")))) / 6
    mass = c.select("mesh_id", area.alias("w"), F.array("v0", "v1", "v2").alias("vs")).select("mesh_id", "w", F.explode("vs").alias("vid")).groupBy("mesh_id", "vid").agg(F.sum("w").alias("w"))
    mean = mass.groupBy("mesh_id").agg(F.avg("w").alias("m"))
    h = M.half_edges(f).select("mesh_id", "a", "b")
    e = h.unionByName(h.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = e.join(x.withColumnRenamed("vid", "b"), ["mesh_id", "b"]).groupBy("mesh_id", F.col("a").alias("vid")).agg(F.count("*").alias("d"), *(F.sum(k).alias(f"s{k}") for k in "xyz"))
    both = x.join(near, ["mesh_id", "vid"]).join(mass, ["mesh_id", "vid"]).join(mean, "mesh_id")
    return both.select("mesh_id", "vid", *(r6(F.col("w") / F.col("m") * F.col(k) + 0.2 * (F.col("d") * F.col(k) - F.col(f"s{k}"))).alias(k) for k in "xyz"))


_AREA = "sum(sqrt(pow((ky - jy) * (lz - jz) - (kz - jz) * (ly - jy), 2) + pow((kz - jz) * (lx - jx) - (kx - jx) * (lz - jz), 2) + pow((kx - jx) * (ly - jy) - (ky - jy) * (lx - jx), 2)) / 2)"


def _rescaled() -> str:
    """Three averages over vertices and their neighbours, then the old area again."""
    smooth = _chain("laplace").rsplit(" SELECT mesh_id, vid, round(", 1)[0]
    area = lambda src, name: f"{name} AS (SELECT f.mesh_id, {_AREA} AS area FROM f JOIN (SELECT mesh_id, vid, x AS jx, y AS jy, z AS jz FROM {src}) j ON j.mesh_id = f.mesh_id AND j.vid = f.v0 JOIN (SELECT mesh_id, vid, x AS kx, y AS ky, z AS kz FROM {src}) k ON k.mesh_id = f.mesh_id AND k.vid = f.v1 JOIN (SELECT mesh_id, vid, x AS lx, y AS ly, z AS lz FROM {src}) l ON l.mesh_id = f.mesh_id AND l.vid = f.v2 GROUP BY f.mesh_id)"
    out = ", ".join(f"round((s.{c} - avg(s.{c}) OVER w) * sqrt(a0.area / a1.area) + avg(s.{c}) OVER w, 6) + 0.0 AS {c}" for c in "xyz")
    return f"{smooth}, {area('v', 'a0')}, {area('s3', 'a1')} SELECT mesh_id, vid, {out} FROM s3 s JOIN a0 USING (mesh_id) JOIN a1 USING (mesh_id) WINDOW w AS (PARTITION BY mesh_id)"


@query("mris_smooth", _rescaled())
def mris_smooth(spark, sf_dir):
    return M.mris_smooth(*torus(spark), iterations=3, rescale=True).select("mesh_id", "vid", *(r6(F.col(c)).alias(c) for c in "xyz"))


def spheres(spark, divisions: int = 2):
    v, f = K.icosphere(divisions)
    bumpy = v * (1 + 0.2 * np.sin(3 * v[:, :1]) * np.cos(2 * v[:, 1:2]))
    return M.from_arrays(spark, {m: (bumpy * (m + 1) * 10, f) for m in range(2)})


@query("mris_inflate", "SELECT CAST(m AS BIGINT) AS mesh_id, 110000.0 AS area, 0.0 AS mean_depth, true AS smoother FROM range(0, 2) r(m)")
def mris_inflate(spark, sf_dir):
    """Area and mean depth after inflation, and whether the surface is nearer to a sphere (tests hold vertices against plain loops)."""
    v, f = spheres(spark)
    s = M.mris_inflate(v, f, averages=2, iterations=3)
    spread = lambda t, n: t.groupBy("mesh_id").agg((F.stddev_pop(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))) / F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).alias(n))
    area = _triangles(s, f).groupBy("mesh_id").agg(F.sum("area").alias("area"))
    depth = s.groupBy("mesh_id").agg(F.avg("sulc").alias("mean_depth"))
    both = area.join(depth, "mesh_id").join(spread(v, "before"), "mesh_id").join(spread(s, "after"), "mesh_id")
    return both.select("mesh_id", (F.round("area", 2) + F.lit(0.0)).alias("area"), (F.round("mean_depth", 6) + F.lit(0.0)).alias("mean_depth"), (F.col("after") < F.col("before")).alias("smoother"))


@query("mris_sphere", "SELECT CAST(m AS BIGINT) AS mesh_id, 162 AS vertices, 0 AS folded, true AS round FROM range(0, 2) r(m)")
def mris_sphere(spark, sf_dir):
    """Faces that look inwards, and whether all vertices are within a hundredth of the radius (tests hold them against plain loops)."""
    v, f = spheres(spark)
    s = M.mris_sphere(v, f, averages=4, iterations=3)
    c = M.corners(s, f)
    from voxelwave.functions import geometry as G

    normal = G.cross(G.sub(F.col("p1"), F.col("p0")), G.sub(F.col("p2"), F.col("p0")))
    folded = c.groupBy("mesh_id").agg(F.sum((G.dot(normal, F.col("p0")) <= 0).cast("int")).cast("int").alias("folded"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    near = s.groupBy("mesh_id").agg(F.count("*").cast("int").alias("vertices"), (F.max(F.abs(r - 100)) < 1).alias("round"))
    return near.join(folded, "mesh_id").select("mesh_id", "vertices", "folded", "round")


@query("mris_remesh", "SELECT CAST(m AS BIGINT) AS mesh_id, CAST(0 AS BIGINT) AS boundary, CAST(0 AS BIGINT) AS non_manifold, 2.0 AS euler FROM range(0, 2) r(m)")
def mris_remesh(spark, sf_dir):
    v, f = M.mris_remesh(*spheres(spark), iterations=2)
    euler = v.groupBy("mesh_id").agg(F.count("*").alias("v")).join(f.groupBy("mesh_id").agg(F.count("*").alias("f")), "mesh_id").select("mesh_id", (F.col("v") - F.col("f") / 2.0).alias("euler"))
    return M.edge_defects(f).join(euler, "mesh_id")


# intensity falls by 8 a unit from 150: 86 lies at radius 8, 62 at radius 11
@query("mris_make_surfaces", "SELECT CAST(0 AS BIGINT) AS mesh_id, CAST(k AS INTEGER) AS vid, true AS near FROM range(0, 162) r(k)")
def mris_make_surfaces(spark, sf_dir):
    v, f = K.icosphere(2)
    g = np.stack(np.meshgrid(*[np.arange(40) - 20.0] * 3, indexing="ij"), -1)
    vol = 150 - 8 * np.linalg.norm(g, axis=-1)
    aff = np.eye(4)
    aff[:3, 3] = -20
    vt, ft = M.from_arrays(spark, {0: (v * 8, f)})
    return M.mris_make_surfaces(vt, ft, vol, aff, 86, 62, averages=1, iterations=6).select("mesh_id", "vid", (F.abs(F.col("thickness") - 3) < 0.6).alias("near"))


@query("mesh_fix_defects", f"SELECT CAST(m AS BIGINT) AS mesh_id, CAST(0 AS BIGINT) AS boundary, CAST(0 AS BIGINT) AS non_manifold, CAST({NU * NV} AS BIGINT) AS vertices FROM range(0, {MESHES}) r(m)")
def mesh_fix_defects(spark, sf_dir):
    v, f = torus(spark)
    v2, f2 = M.fix_defects(v, f.where("fid <> 7 AND fid <> 100"))
    return M.edge_defects(f2).join(v2.groupBy("mesh_id").agg(F.count("*").alias("vertices")), "mesh_id")


@query("mesh_uniform_remesh", "SELECT CAST(0 AS BIGINT) AS mesh_id, CAST(0 AS BIGINT) AS boundary, CAST(0 AS BIGINT) AS non_manifold, true AS near")
def mesh_uniform_remesh(spark, sf_dir):
    v, f = K.icosphere(2)
    vt, ft = M.from_arrays(spark, {0: (v, f)})
    a, b = M.uniform_remesh(vt, ft, voxel=0.25)
    return M.edge_defects(b).join(M.volume(a, b).select("mesh_id", (F.abs(F.col("volume") / (4 * np.pi / 3) - 1) < 0.1).alias("near")), "mesh_id")


@query("mesh_subdivide_length", f"SELECT CAST(m AS BIGINT) AS mesh_id, true AS short_enough, CAST(0 AS BIGINT) AS boundary, CAST(0 AS BIGINT) AS non_manifold FROM range(0, {MESHES}) r(m)")
def mesh_subdivide_length(spark, sf_dir):
    v, f = M.subdivide_to_length(*torus(spark), 0.5)
    return M.edge_lengths(v, f).select("mesh_id", (F.col("max_edge") <= 0.5).alias("short_enough")).join(M.edge_defects(f), "mesh_id")


@query("mesh_patch")
def mesh_patch(spark, sf_dir):
    vt, ft = M.from_arrays(spark, {0: K.icosphere(3)})
    p = M.patch(vt, ft, np.array([[1, 0, 0.5], [0, 1, 0.5], [-1, 0, 0.5], [0, -1, 0.5]]))
    return p.groupBy("mesh_id", "side").agg(F.count("*").alias("faces"))


@query("surface_path")
def surface_path(spark, sf_dir):
    vt, ft = M.from_arrays(spark, {0: K.icosphere(2)})
    return M.surface_path(M.geodesic(vt, ft, 0), 7).select("mesh_id", "step", "vid", r6(F.col("distance")).alias("distance"))


def _catmull(kind: str, closed: bool) -> str:
    power = {"centripetal": 0.25, "chordal": 0.5}.get(kind)
    pts = "e AS (SELECT label AS curve, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"
    if closed:
        near = lambda d: f"q{d + 1}.curve = e.curve AND q{d + 1}.k = (e.k + {d} + e.n) % e.n"
        col = lambda d, c: f"q{d + 1}.{c}"
        segments = "e.n > 1"
    else:
        near = lambda d: f"q{d + 1}.curve = e.curve AND q{d + 1}.k = e.k + {d}"
        col = lambda d, c: {-1: f"coalesce(q0.{c}, 2 * e.{c} - q2.{c})", 1: f"q2.{c}", 2: f"coalesce(q3.{c}, 2 * q2.{c} - e.{c})"}[d]
        segments = "e.k < e.n - 1"
    cols = ", ".join(f"e.{c} AS {c}1, {col(-1, c)} AS {c}0, {col(1, c)} AS {c}2, {col(2, c)} AS {c}3" for c in "xyz")
    seg = f"s AS (SELECT e.curve, e.vec_id, {cols} FROM e LEFT JOIN e q0 ON {near(-1)} LEFT JOIN e q2 ON {near(1)} LEFT JOIN e q3 ON {near(2)} WHERE {segments})"
    if power:
        gap = lambda k: f"pow(pow(x{k} - x{k + 1}, 2) + pow(y{k} - y{k + 1}, 2) + pow(z{k} - z{k + 1}, 2), {power})"
        seg += f", g AS (SELECT *, {gap(0)} AS a0, {gap(1)} AS a1, {gap(2)} AS a2 FROM s), h AS (SELECT *, CASE WHEN a1 < 1e-4 THEN 1 ELSE a1 END AS d1 FROM g), w AS (SELECT *, CASE WHEN a0 < 1e-4 THEN d1 ELSE a0 END AS d0, CASE WHEN a2 < 1e-4 THEN d1 ELSE a2 END AS d2 FROM h)"
        t1 = lambda c: f"(({c}1 - {c}0) / d0 - ({c}2 - {c}0) / (d0 + d1) + ({c}2 - {c}1) / d1) * d1"
        t2 = lambda c: f"(({c}2 - {c}1) / d1 - ({c}3 - {c}1) / (d1 + d2) + ({c}3 - {c}2) / d2) * d1"
    else:
        seg += ", w AS (SELECT * FROM s)"
        t1, t2 = (lambda c: f"0.5 * ({c}2 - {c}0)"), (lambda c: f"0.5 * ({c}3 - {c}1)")
    out = ", ".join(f"round((2 * t * t * t - 3 * t * t + 1) * {c}1 + (t * t * t - 2 * t * t + t) * {t1(c)} + (3 * t * t - 2 * t * t * t) * {c}2 + (t * t * t - t * t) * {t2(c)}, 6) + 0.0 AS {c}" for c in "xyz")
    return f"WITH {pts}, {seg} SELECT vec_id, CAST(step AS INTEGER) AS step, {out} FROM (SELECT *, step / 16.0::DOUBLE AS t FROM w, range(0, 16) r(step))"


for _name, _kind, _closed in (("catmull_rom", "centripetal", False), ("catmull_rom_closed", "centripetal", True), ("catmull_rom_uniform", "uniform", False), ("catmull_rom_chordal", "chordal", False)):

    @query(_name, _catmull(_kind, _closed))
    def catmull_rom(spark, sf_dir, kind=_kind, closed=_closed):
        """One curve a label, through all of its embeddings."""
        e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("curve"), "vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
        return M.catmull_rom(e, ["curve"], "vec_id", kind=kind, closed=closed).select("vec_id", "step", *(r6(F.col(c)).alias(c) for c in "xyz"))


# the eye looks down the z axis from 1000
@query("mesh_plot_table", f"{T} SELECT mesh_id, fid, round((az + bz + cz) / 3 - 1000, 6) + 0.0 AS depth, round(ax, 6) + 0.0 AS x0, round(by_, 6) + 0.0 AS y1, round(cx, 6) + 0.0 AS x2 FROM t")
def mesh_plot_table(spark, sf_dir):
    return M.plot_table(*torus(spark)).select("mesh_id", "fid", *(r6(F.col(c)).alias(c) for c in ("depth", "x0", "y1", "x2")))
