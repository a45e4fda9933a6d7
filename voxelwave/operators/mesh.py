"""Mesh operators over vertex tables (mesh_id, vid, x, y, z) and face tables (mesh_id, fid, v0, v1, v2), ids from 0.

Measures, normals, edges, subsets, subdivision and ray hits are joins and groupings; iterative and search-heavy operators run
as numpy kernels on one mesh a group (co-grouped by mesh_id).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.functions import geometry as G
from voxelwave.functions import mesh as K
from voxelwave.runtime import cut, ship

VERTICES = "mesh_id long, vid int, x double, y double, z double"
FACES = "mesh_id long, fid int, v0 int, v1 int, v2 int"


def from_arrays(spark, meshes: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Tables of a few meshes held on the driver."""
    v = [(int(m), i, *map(float, p)) for m, (vs, _) in meshes.items() for i, p in enumerate(vs)]
    f = [(int(m), i, *map(int, t)) for m, (_, fs) in meshes.items() for i, t in enumerate(fs)]
    return spark.createDataFrame(v, VERTICES), spark.createDataFrame(f, FACES)


def corners(v: DataFrame, f: DataFrame) -> DataFrame:
    """Faces with the points of their corners, p0, p1, p2."""
    point = v.select("mesh_id", "vid", G.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    out = f
    for k in range(3):
        out = out.join(point.select("mesh_id", F.col("vid").alias(f"v{k}"), F.col("p").alias(f"p{k}")), ["mesh_id", f"v{k}"])
    return out


def half_edges(f: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.col(f"v{a}").alias("a"), F.col(f"v{b}").alias("b")) for a, b in ((0, 1), (1, 2), (2, 0))))
    return f.select("mesh_id", "fid", F.explode(pairs).alias("e")).select("mesh_id", "fid", "e.a", "e.b")


def edge_table(f: DataFrame) -> DataFrame:
    """Distinct undirected edges and how many faces have each."""
    h = half_edges(f)
    return h.groupBy("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def volume(v: DataFrame, f: DataFrame) -> DataFrame:
    c = corners(v, f)
    return c.groupBy("mesh_id").agg((F.sum(G.dot(F.col("p0"), G.cross(F.col("p1"), F.col("p2")))) / 6).alias("volume"))


def area(v: DataFrame, f: DataFrame) -> DataFrame:
    c = corners(v, f)
    n = G.cross(G.sub(F.col("p1"), F.col("p0")), G.sub(F.col("p2"), F.col("p0")))
    return c.groupBy("mesh_id").agg((F.sum(G.length(n)) / 2).alias("area"))


def edge_defects(f: DataFrame) -> DataFrame:
    return edge_table(f).groupBy("mesh_id").agg(F.count(F.when(F.col("n") == 1, 1)).alias("boundary"), F.count(F.when(F.col("n") > 2, 1)).alias("non_manifold"))


def edge_lengths(v: DataFrame, f: DataFrame) -> DataFrame:
    """Mean over the edges of faces (shared ones count twice) and the longest."""
    c = corners(v, f)
    d = F.explode(F.array(*(G.distance_to(F.col(f"p{a}"), F.col(f"p{b}")) for a, b in ((0, 1), (1, 2), (2, 0)))))
    return c.select("mesh_id", d.alias("d")).groupBy("mesh_id").agg(F.avg("d").alias("mean_edge"), F.max("d").alias("max_edge"))


def update_normals(v: DataFrame, f: DataFrame, weight: str = "area") -> DataFrame:
    """Vertices with unit normals nx, ny, nz."""
    c = corners(v, f)
    # plain doubles stage by stage: edges, then cross product and dot products, then angles
    ends = (("a", 0, 1), ("b", 1, 2), ("c", 2, 0))
    c = c.select("mesh_id", "v0", "v1", "v2", *((F.col(f"p{j}.{x}") - F.col(f"p{i}.{x}")).alias(f"{n}{x}") for n, i, j in ends for x in "xyz"))
    dot = lambda p, q: sum((F.col(f"{p}{x}") * F.col(f"{q}{x}") for x in "yz"), F.col(f"{p}x") * F.col(f"{q}x"))
    turn = (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))
    c = c.select("*", *((F.col(f"a{q}") * F.col(f"b{r}") - F.col(f"a{r}") * F.col(f"b{q}")).alias(f"n{p}") for p, q, r in turn), *(F.sqrt(dot(n, n)).alias(f"l{n}") for n in "abc"), *((-dot(p, q)).alias(f"d{k}") for k, (p, q) in enumerate(("ac", "ab", "bc"))))
    if weight == "area":
        w = [F.lit(1.0)] * 3
    else:
        size = F.sqrt(dot("n", "n"))
        sides = (("la", "lc"), ("la", "lb"), ("lb", "lc"))
        cos = [F.try_divide(F.col(f"d{k}"), F.col(p) * F.col(q)) for k, (p, q) in enumerate(sides)]
        c = c.select("*", *(F.coalesce(F.try_divide(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))), size), F.lit(0.0)).alias(f"w{k}") for k, x in enumerate(cos)))
        w = [F.col(f"w{k}") for k in range(3)]
    per = [F.struct(F.col(f"v{k}").alias("vid"), F.struct(*((F.col(f"n{x}") * w[k]).alias(x) for x in "xyz")).alias("n")) for k in range(3)]
    sums = c.select("mesh_id", F.explode(F.array(*per)).alias("c")).groupBy("mesh_id", F.col("c.vid").alias("vid")).agg(*(F.sum(f"c.n.{a}").alias(f"s{a}") for a in "xyz"))
    d = v.join(sums, ["mesh_id", "vid"], "left")
    u = G.normalize(G.vec(*(F.coalesce(F.col(f"s{a}"), F.lit(0.0)) for a in "xyz")))
    return d.withColumn("_u", u).select("mesh_id", "vid", "x", "y", "z", *(F.col(f"_u.{a}").alias(f"n{a}") for a in "xyz"))


def subset_vertices(v: DataFrame, f: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Chosen vertices, numbered anew, and the faces that have all their corners among them."""
    w = W.partitionBy("mesh_id")
    kept = v.where(keep).withColumn("_new", (F.row_number().over(w.orderBy("vid")) - 1).cast("int"))
    names = kept.select("mesh_id", "vid", "_new")
    out = f
    for k in range(3):
        out = out.join(names.select("mesh_id", F.col("vid").alias(f"v{k}"), F.col("_new").alias(f"n{k}")), ["mesh_id", f"v{k}"])
    faces = out.select("mesh_id", (F.row_number().over(w.orderBy("fid")) - 1).cast("int").alias("fid"), *(F.col(f"n{k}").alias(f"v{k}") for k in range(3)))
    return kept.select("mesh_id", F.col("_new").alias("vid"), "x", "y", "z"), faces


def subdivide(v: DataFrame, f: DataFrame, method: str = "edge") -> tuple[DataFrame, DataFrame]:
    """Edge midpoints (each face becomes four) or barycentres (three)."""
    sizes = v.groupBy("mesh_id").agg((F.max("vid") + 1).alias("_n"))
    w = W.partitionBy("mesh_id")
    if method == "barycenter":
        total = f.groupBy("mesh_id").agg(F.count(F.lit(1)).cast("int").alias("_m"))
        c = corners(v, f).join(sizes, "mesh_id").join(total, "mesh_id")
        centre = (F.col("_n") + F.col("fid")).cast("int")
        made = c.select("mesh_id", centre.alias("vid"), *(((F.col(f"p0.{a}") + F.col(f"p1.{a}") + F.col(f"p2.{a}")) / 3).alias(a) for a in "xyz"))
        new = F.array(*(F.struct((F.col("_m") * k + F.col("fid")).alias("fid"), F.col(f"v{k}").alias("v0"), F.col(f"v{(k + 1) % 3}").alias("v1"), centre.alias("v2")) for k in range(3)))
        return v.unionByName(made), c.select("mesh_id", F.explode(new).alias("t")).select("mesh_id", "t.*")
    e = edge_table(f).join(sizes, "mesh_id").withColumn("_id", (F.col("_n") + F.row_number().over(w.orderBy("a", "b")) - 1).cast("int"))
    ends = e
    for k in ("a", "b"):
        ends = ends.join(v.select("mesh_id", F.col("vid").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), ["mesh_id", k])
    made = ends.select("mesh_id", F.col("_id").alias("vid"), *(((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"))
    h = half_edges(f).select("mesh_id", "fid", "a", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    mids = h.join(e.select("mesh_id", F.col("a").alias("lo"), F.col("b").alias("hi"), "_id"), ["mesh_id", "lo", "hi"])
    by_corner = mids.groupBy("mesh_id", "fid").agg(F.map_from_entries(F.collect_list(F.struct("a", "_id"))).alias("mid"))
    d = f.join(by_corner, ["mesh_id", "fid"])
    total = f.groupBy("mesh_id").agg(F.count(F.lit(1)).cast("int").alias("_m"))
    a, b, c = (F.col(f"v{k}") for k in range(3))
    ab, bc, ca = (F.col("mid")[x] for x in (a, b, c))
    new = [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
    tris = F.array(*(F.struct((F.col("_m") * k + F.col("fid")).alias("fid"), x.alias("v0"), y.alias("v1"), z.alias("v2")) for k, (x, y, z) in enumerate(new)))
    return v.unionByName(made), d.join(total, "mesh_id").select("mesh_id", F.explode(tris).alias("t")).select("mesh_id", "t.*")


def smooth_average(v: DataFrame, f: DataFrame, iterations: int = 10, every: int = 4) -> DataFrame:
    """One-ring averages that include the vertex; the table is written every few rounds, so plans stay short."""
    e = edge_table(f).select("mesh_id", "a", "b")
    both = cut(e.unionByName(e.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(v.select("mesh_id", F.col("vid").alias("a"), F.col("vid").alias("b"))), "ring")
    for k in range(iterations):
        near = both.join(v.withColumnRenamed("vid", "b"), ["mesh_id", "b"])
        v = near.groupBy("mesh_id", F.col("a").alias("vid")).agg(*(F.avg(c).alias(c) for c in "xyz"))
        if k % every == every - 1:
            v = cut(v, "smooth")
    return v


#: Rays of a mesh that meet one copy of its faces.
RAY_BLOCK = 4096


def raycast(v: DataFrame, f: DataFrame, rays: DataFrame, max_distance: float | None = None, both_sides: bool = False, normals: bool = True) -> DataFrame:
    """First hit of each ray (mesh_id, ray_id, ox..oz, dx..dz): distance, face, point, and normal (of its corners); nulls for misses.

    The rays of a mesh are dealt into blocks, each with a copy of the faces, so that no mesh is one task's load; hits are reduced
    to one row a ray before anything else is joined.
    """
    flat = lambda c, n: [c[a].alias(f"{n}{a}") for a in "xyz"]
    faces = corners(v, f)
    # both sides become tables of plain doubles, so that no expression is repeated inside another
    faces = cut(faces.select("mesh_id", F.col("fid").alias("face"), *flat(F.col("p0"), "a"), *flat(G.sub(F.col("p1"), F.col("p0")), "e"), *flat(G.sub(F.col("p2"), F.col("p0")), "g")), "faces")
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    signs = F.array(*(F.lit(s) for s in ((1.0, -1.0) if both_sides else (1.0,))))
    r = rays.select("*", F.explode(signs).alias("sign"), size.alias("_n"))
    r = r.select("mesh_id", "ray_id", "sign", "ox", "oy", "oz", *((F.col(f"d{a}") * F.col("sign") / F.col("_n")).alias(f"d{a}") for a in "xyz"))
    r = cut(r.select("*", *((F.col(f"o{a}") - 1e-6 * F.col(f"d{a}")).alias(f"q{a}") for a in "xyz")), "rays")

    def cross(n: str, p: str, q: str) -> list:
        return [(F.col(f"{p}{b}") * F.col(f"{q}{c}") - F.col(f"{p}{c}") * F.col(f"{q}{b}")).alias(f"{n}{a}") for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))]

    def dot(p: str, q: str):
        return F.col(f"{p}x") * F.col(f"{q}x") + F.col(f"{p}y") * F.col(f"{q}y") + F.col(f"{p}z") * F.col(f"{q}z")

    blocks = r.groupBy("mesh_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(RAY_BLOCK)).alias("blocks"))
    r = r.join(blocks, "mesh_id").withColumn("block", F.pmod(F.xxhash64("ray_id"), F.col("blocks"))).drop("blocks")
    dealt = faces.join(blocks, "mesh_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    t = r.join(dealt, ["mesh_id", "block"]).select("*", *cross("h", "d", "g"), *((F.col(f"q{a}") - F.col(f"a{a}")).alias(f"s{a}") for a in "xyz"))
    t = t.withColumn("det", dot("e", "h")).where(F.abs("det") > 1e-12).withColumn("u", F.try_divide(dot("s", "h"), F.col("det"))).where((F.col("u") >= -1e-9) & (F.col("u") <= 1 + 1e-9))
    t = t.select("*", *cross("k", "s", "e")).withColumn("w", F.try_divide(dot("d", "k"), F.col("det"))).where((F.col("w") >= -1e-9) & (F.col("u") + F.col("w") <= 1 + 1e-9))
    t = t.withColumn("t", F.try_divide(dot("g", "k"), F.col("det"))).where("t >= 0").withColumn("far", F.col("t") - 1e-6)
    if max_distance is not None:
        t = t.where(F.col("far") <= max_distance)
    best = t.groupBy("mesh_id", "ray_id").agg(F.min(F.struct("far", "face", "sign", "ox", "oy", "oz", "dx", "dy", "dz")).alias("b"))
    hits = best.select("mesh_id", "ray_id", (F.col("b.far") * F.col("b.sign")).alias("distance"), "b.face", *((F.col(f"b.o{a}") + F.col(f"b.d{a}") * F.col("b.far")).alias(f"p{a}") for a in "xyz"))
    if normals:
        at = corners(update_normals(v, f).select("mesh_id", "vid", *(F.col(f"n{a}").alias(a) for a in "xyz")), f)
        total = at.select("mesh_id", F.col("fid").alias("face"), *((F.col(f"p0.{a}") + F.col(f"p1.{a}") + F.col(f"p2.{a}")).alias(a) for a in "xyz"))
        size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        hits = hits.join(total.select("mesh_id", "face", *(F.try_divide(F.col(a), size).alias(f"n{a}") for a in "xyz")), ["mesh_id", "face"])
    return rays.select("mesh_id", "ray_id").join(hits, ["mesh_id", "ray_id"], "left")


# ---------------------------------------------------------------- kernels by mesh


def per_mesh(v: DataFrame, f: DataFrame, kernel: Callable[[int, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """A kernel on each mesh's arrays; it returns a dict of the schema's columns behind mesh_id."""
    ship(v.sparkSession)
    from voxelwave.operators.signal import _arrow_types, _split

    names, kinds = [p.strip().split(" ")[0] for p in _split(schema)], _arrow_types(v, schema)

    def run(key, a, b):
        a, b = a.sort_by("vid"), b.sort_by("fid")
        vs = np.column_stack([a.column(c).to_numpy() for c in "xyz"]) if a.num_rows else np.zeros((0, 3))
        fs = np.column_stack([b.column(f"v{k}").to_numpy() for k in range(3)]).astype(int) if b.num_rows else np.zeros((0, 3), int)
        m = key[0].as_py()
        out = kernel(m, vs, fs)
        n = len(out[names[0]])
        return pa.table([pa.array([m] * n, pa.int64()), *(pa.array(out[c].tolist() if isinstance(out[c], np.ndarray) else out[c], k) for c, k in zip(names, kinds))], ["mesh_id", *names])

    return v.select("mesh_id", "vid", "x", "y", "z").groupBy("mesh_id").cogroup(f.select("mesh_id", "fid", "v0", "v1", "v2").groupBy("mesh_id")).applyInArrow(run, f"mesh_id long, {schema}")


def remade(v: DataFrame, f: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """A kernel that gives a new mesh: both tables come from one pass, told apart by a flag."""
    def run(_, vs, fs):
        a, b = kernel(vs, fs)
        n, m = len(a), len(b)
        nul = lambda k: [None] * k
        return {"is_face": [False] * n + [True] * m, "id": [*range(n), *range(m)], **{c: a[:, i].tolist() + nul(m) for i, c in enumerate("xyz")}, **{f"v{i}": nul(n) + b[:, i].tolist() for i in range(3)}}

    both = cut(per_mesh(v, f, run, "is_face boolean, id int, x double, y double, z double, v0 int, v1 int, v2 int"), "mesh")
    return both.where(~F.col("is_face")).select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"), both.where("is_face").select("mesh_id", F.col("id").alias("fid"), "v0", "v1", "v2")


def _moved(v: DataFrame, f: DataFrame, kernel) -> DataFrame:
    def run(_, vs, fs):
        a = kernel(vs, fs)
        return {"vid": np.arange(len(a)), **{c: a[:, i] for i, c in enumerate("xyz")}}

    return per_mesh(v, f, run, "vid int, x double, y double, z double")


def smooth_explicit(v, f, kind="taubin", **options) -> DataFrame:
    return _moved(v, f, lambda a, b: K.smooth_explicit(a, b, kind, **options))


def smooth_implicit(v, f, **options) -> DataFrame:
    return _moved(v, f, lambda a, b: K.smooth_implicit(a, b, **options))


def mris_smooth(v, f, **options) -> DataFrame:
    return _moved(v, f, lambda a, b: K.average_smooth(a, b, **options))


def mris_sphere(v, f, **options) -> DataFrame:
    return _moved(v, f, lambda a, b: K.to_sphere(a, b, **options))


def mris_inflate(v, f, **options) -> DataFrame:
    def run(_, vs, fs):
        r = K.inflate(vs, fs, **options)
        return {"vid": np.arange(len(vs)), **{c: r["vertices"][:, i] for i, c in enumerate("xyz")}, "sulc": r["sulc"]}

    return per_mesh(v, f, run, "vid int, x double, y double, z double, sulc double")


def mris_curvature(v, f) -> DataFrame:
    def run(_, vs, fs):
        c = K.curvature(vs, fs)
        return {"vid": np.arange(len(vs)), **c}

    return per_mesh(v, f, run, "vid int, k1 double, k2 double, mean double, gauss double")


def mris_remesh(v, f, **options):
    return remade(v, f, lambda a, b: K.remesh(a, b, **options))


def mris_make_surfaces(v, f, volume_: np.ndarray, vox2ras: np.ndarray, white: float, pial: float, **options) -> DataFrame:
    def run(_, vs, fs):
        r = K.make_surfaces(vs, fs, volume_, vox2ras, white, pial, **options)
        return {"vid": np.arange(len(vs)), **{f"white_{c}": r["white"][:, i] for i, c in enumerate("xyz")}, **{f"pial_{c}": r["pial"][:, i] for i, c in enumerate("xyz")}, "thickness": r["thickness"]}

    return per_mesh(v, f, run, "vid int, white_x double, white_y double, white_z double, pial_x double, pial_y double, pial_z double, thickness double")


def fix_defects(v, f, **options):
    return remade(v, f, lambda a, b: K.fix_defects(a, b, **options))


def uniform_remesh(v, f, **options):
    return remade(v, f, lambda a, b: K.uniform_remesh(a, b, **options))


def subdivide_to_length(v, f, longest: float, rounds: int | None = None):
    return remade(v, f, lambda a, b: K.subdivide_to_length(a, b, longest, rounds))


def geodesic(v, f, start: int | Sequence[int], max_distance: float | None = None) -> DataFrame:
    """(mesh_id, vid, prev, distance): shortest edge paths; null where out of reach."""
    def run(_, vs, fs):
        d, p = K.dijkstra(vs, fs, start, max_distance)
        ok = np.isfinite(d)
        return {"vid": np.arange(len(vs)), "prev": [int(x) if x >= 0 else None for x in p], "distance": [float(x) if k else None for x, k in zip(d, ok)]}

    return per_mesh(v, f, run, "vid int, prev int, distance double")


def surface_path(distances: DataFrame, node: int) -> DataFrame:
    """(mesh_id, step, vid) from a start to a node, by following previous vertices with one join a doubling."""
    jump = distances.select("mesh_id", "vid", F.coalesce("prev", "vid").alias("to"))
    reach = distances.where(F.col("vid") == node).select("mesh_id", "vid")
    far = distances.agg(F.count(F.lit(1))).first()[0]
    steps = 1
    while steps < max(2, far):
        hop = reach.join(jump, ["mesh_id", "vid"]).select("mesh_id", F.col("to").alias("vid"))
        reach = cut(reach.unionByName(hop).distinct(), "path")
        nxt = jump.alias("a").join(jump.alias("b"), (F.col("a.mesh_id") == F.col("b.mesh_id")) & (F.col("a.to") == F.col("b.vid"))).select("a.mesh_id", "a.vid", F.col("b.to").alias("to"))
        jump = cut(nxt, "jump")
        steps *= 2
    found = reach.join(distances, ["mesh_id", "vid"])
    return found.select("mesh_id", (F.row_number().over(W.partitionBy("mesh_id").orderBy("distance", "vid")) - 1).alias("step"), "vid", "distance")


def patch(v, f, waypoints: np.ndarray, **options) -> DataFrame:
    """(mesh_id, fid, side): 0 on the near side of the loop through the way points, 1 beyond."""
    def run(_, vs, fs):
        _, faces, near, far, _ = K.patch(vs, fs, waypoints, **options)
        side = np.ones(len(faces), int)
        side[near] = 0
        return {"fid": np.arange(len(faces)), "side": side}

    return per_mesh(v, f, run, "fid int, side int")


def isosurface(spark, volumes: dict[int, np.ndarray], vox2ras: np.ndarray | None = None, threshold: float = 0.5):
    return from_arrays(spark, {k: K.isosurface(np.asarray(m) > threshold, vox2ras) for k, m in volumes.items()})


def isosurface_table(voxels: DataFrame, dim: Sequence[int], vox2ras: np.ndarray | None = None, low: float = 0.0, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Surfaces of the threshold band of volumes in long form (vol_id, i, j, k, value): one volume a group."""
    ship(voxels.sparkSession)

    def run(key, t):
        mask = np.zeros(tuple(dim), bool)
        x = t.column("value").to_numpy()
        ok = (x > low) & (x <= high if high is not None else True)
        mask[tuple(t.column(c).to_numpy()[ok] for c in "ijk")] = True
        v, f = K.isosurface(mask, vox2ras)
        n, m = len(v), len(f)
        cols = [[key[0].as_py()] * (n + m), [False] * n + [True] * m, [*range(n), *range(m)], *(v[:, i].tolist() + [None] * m for i in range(3)), *([None] * n + f[:, i].tolist() for i in range(3))]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.float64()] * 3, *[pa.int32()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["mesh_id", "is_face", "id", "x", "y", "z", "v0", "v1", "v2"])

    both = cut(voxels.select(F.col("vol_id").cast("long").alias("vol_id"), "i", "j", "k", F.col("value").cast("double").alias("value")).groupBy("vol_id").applyInArrow(run, "mesh_id long, is_face boolean, id int, x double, y double, z double, v0 int, v1 int, v2 int"), "iso")
    return both.where(~F.col("is_face")).select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"), both.where("is_face").select("mesh_id", F.col("id").alias("fid"), "v0", "v1", "v2")


def knn(target: DataFrame, query: DataFrame, k: int = 1, block: int = 65536) -> DataFrame:
    """(query_id, rank, target_id, distance) of points (id, x, y, z); ties by id.

    Targets are dealt into bounded blocks and every block meets every block of queries once, as arrays; each gives its k best.
    """
    ship(target.sparkSession)
    t, q = cut(target.select("id", "x", "y", "z"), "points"), cut(query.select("id", "x", "y", "z"), "points")
    n_t, n_q = max(1, -(-t.count() // block)), max(1, -(-q.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.withColumn("qb", deal(n_q)).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
    right = t.withColumn("tb", deal(n_t)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(key, a, b):
        b = b.sort_by("id")
        p, r = (np.column_stack([x.column(c).to_numpy() for c in "xyz"]) for x in (a, b))
        if not len(p) or not len(r):
            return pa.table({"query_id": pa.array([], pa.int64()), "target_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        d, i = K.knn(r, p, k)
        return pa.table({"query_id": np.repeat(a.column("id").to_numpy(), d.shape[1]), "target_id": b.column("id").to_numpy()[i].reshape(-1), "distance": d.reshape(-1).astype(float)})

    found = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInArrow(run, "query_id long, target_id long, distance double")
    w = W.partitionBy("query_id").orderBy("distance", "target_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "target_id", "distance")


def catmull_rom(points: DataFrame, by: Sequence[str], order: str, per_segment: int = 16, kind: str = "centripetal", tension: float = 0.5, closed: bool = False) -> DataFrame:
    """(by, order, step, x, y, z): points of the curve through ordered control points, by expressions over neighbours.

    ``kind`` is centripetal, chordal or uniform (``tension`` is the last one's). The ends of an open curve are mirrored; a closed
    one has a segment from its last point to its first. A curve of one point has no segment.
    """
    w = W.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = G.vec(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    d = points.select(*by, order, p.alias("p1"))
    near = {"p0": F.lag("p1").over(w), "p2": F.lead("p1").over(w), "p3": F.lead("p1", 2).over(w)}
    if closed:
        first, second, last = F.first("p1").over(whole), F.nth_value("p1", 2).over(whole), F.last("p1").over(whole)
        d = d.select("*", near["p0"].alias("p0"), near["p2"].alias("p2"), near["p3"].alias("p3"), first.alias("_f"), second.alias("_s"), last.alias("_l"))
        d = d.select(*by, order, "p1", F.coalesce("p0", "_l").alias("p0"), F.coalesce("p2", "_f").alias("p2"), F.when(F.col("p2").isNull(), F.col("_s")).otherwise(F.coalesce("p3", "_f")).alias("p3")).where("p3 IS NOT NULL")
    else:
        d = d.select("*", *(c.alias(n) for n, c in near.items())).where("p2 IS NOT NULL")
        mirror = lambda a, b: G.sub(G.multiply_scalar(a, 2.0), b)
        d = d.withColumn("p0", F.coalesce("p0", mirror(F.col("p1"), F.col("p2")))).withColumn("p3", F.coalesce("p3", mirror(F.col("p2"), F.col("p1"))))
    if kind == "uniform":
        slope = lambda a, k: tension * (F.col(f"p{k + 1}.{a}") - F.col(f"p{k - 1}.{a}"))
    else:
        power = {"centripetal": 0.25, "chordal": 0.5}[kind]
        gap = lambda k: F.pow(G.distance_to_squared(F.col(f"p{k}"), F.col(f"p{k + 1}")), F.lit(power))
        d = d.select("*", *(gap(k).alias(f"d{k}") for k in range(3)))
        # points that coincide are taken as one apart, or as their neighbours are
        d = d.withColumn("d1", F.when(F.col("d1") < 1e-4, 1.0).otherwise(F.col("d1")))
        d = d.withColumns({f"d{k}": F.when(F.col(f"d{k}") < 1e-4, F.col("d1")).otherwise(F.col(f"d{k}")) for k in (0, 2)})
        diff = lambda a, j, k: F.col(f"p{k}.{a}") - F.col(f"p{j}.{a}")

        def slope(a, k):
            before, after = F.col(f"d{k - 1}"), F.col(f"d{k}")
            return (diff(a, k - 1, k) / before - diff(a, k - 1, k + 1) / (before + after) + diff(a, k, k + 1) / after) * F.col("d1")

    t = F.col("step") / float(per_segment)
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_segment - 1))).alias("step"))
    h = [2 * t * t * t - 3 * t * t + 1, t * t * t - 2 * t * t + t, 3 * t * t - 2 * t * t * t, t * t * t - t * t]
    coord = lambda a: h[0] * F.col(f"p1.{a}") + h[1] * slope(a, 1) + h[2] * F.col(f"p2.{a}") + h[3] * slope(a, 2)
    return d.select(*by, order, "step", *(coord(a).alias(a) for a in "xyz"))


def plot_table(v: DataFrame, f: DataFrame, eye=(0.0, 0.0, 1000.0), lookat=(0.0, 0.0, 0.0), up=(0.0, 1.0, 0.0)) -> DataFrame:
    """What a painter would draw: faces in camera coordinates with their depth, to be drawn far to near."""
    z = K.unit(np.subtract(eye, lookat, dtype=float))
    x = K.unit(np.cross(up, z))
    pose = np.eye(4)
    pose[:3] = np.column_stack([x, np.cross(z, x), z, eye])
    view = G.matrix(np.linalg.inv(pose).tolist())
    cam = v.select("mesh_id", "vid", G.apply_matrix4(G.vec(F.col("x"), F.col("y"), F.col("z")), view).alias("p")).select("mesh_id", "vid", "p.x", "p.y", "p.z")
    c = corners(cam, f)
    depth = (F.col("p0.z") + F.col("p1.z") + F.col("p2.z")) / 3
    return c.select("mesh_id", "fid", *(F.col(f"p{k}.{a}").alias(f"{a}{k}") for k in range(3) for a in "xy"), depth.alias("depth"))
