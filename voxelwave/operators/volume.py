"""Volume operators. Long tables (vol_id, i, j, k, value) are resampled and grown by equi-joins; searches run as kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelwave.functions import volume as K
from voxelwave.runtime import ship


def target_grid(volumes: DataFrame, dim: Sequence[int]) -> DataFrame:
    """All voxels of the target grid for each volume id; the grid is generated, not shipped."""
    nx, ny, nz = dim
    ids = volumes.select("vol_id").distinct()
    planes = ids.select("vol_id", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))).alias("k"))
    rows = planes.select("vol_id", "k", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("j"))
    return rows.select("vol_id", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"), "j", "k")


def _coordinate(m: np.ndarray, r: int) -> Column:
    return F.col("i") * float(m[r, 0]) + F.col("j") * float(m[r, 1]) + F.col("k") * float(m[r, 2]) + float(m[r, 3])


def resample(volumes: DataFrame, old_dim: Sequence[int], new_dim: Sequence[int], old: np.ndarray, new: np.ndarray, how: str = "nearest", fill=None, transform: np.ndarray | None = None) -> DataFrame:
    """Volumes on another grid. Nearest is one equi-join (any value type); trilinear and cubic join their taps and sum.

    ``transform`` maps target RAS to source RAS. Places outside the old grid give ``fill``.
    """
    m = np.linalg.inv(np.asarray(old, float)) @ (np.eye(4) if transform is None else np.asarray(transform, float)) @ np.asarray(new, float)
    grid = target_grid(volumes, new_dim)
    # coordinates that only miss a voxel by rounding errors belong to it
    at = grid.select("vol_id", "i", "j", "k", *(F.round(_coordinate(m, r), 9).alias(c) for r, c in enumerate(("x", "y", "z"))))
    source = volumes.select("vol_id", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("k").alias("_k"), F.col("value").alias("_v"))
    keys = ["vol_id", "_i", "_j", "_k"]
    if how == "nearest":
        out = at.select("vol_id", "i", "j", "k", *((F.rint(c) + F.lit(0.0)).cast("int").alias(n) for c, n in zip("xyz", keys[1:]))).join(source, keys, "left")
        made = F.col("_v") if fill is None else F.coalesce("_v", F.lit(fill))
        return out.select("vol_id", "i", "j", "k", made.alias("value"))
    inside = F.lit(True)
    for c, n in zip("xyz", old_dim):
        inside = inside & (F.col(c) >= 0) & (F.col(c) <= n - 1)
    if how == "trilinear":
        offsets, weight = (0, 1), lambda t, d: t if d else 1 - t
    else:
        offsets = (-1, 0, 1, 2)

        def weight(t, d):
            return {-1: ((-0.5 * t + 1) * t - 0.5) * t, 0: (1.5 * t - 2.5) * t * t + 1, 1: ((-1.5 * t + 2) * t + 0.5) * t, 2: (0.5 * t - 0.5) * t * t}[d]

    per_axis = []
    for c, n in zip("xyz", old_dim):
        low = F.floor(c).cast("int")
        t = F.col(c) - low
        per_axis.append(F.array(*(F.struct(F.greatest(F.lit(0), F.least(F.lit(n - 1), low + d)).alias("p"), weight(t, d).alias("w")) for d in offsets)))
    taps = at.where(inside).select("vol_id", "i", "j", "k", F.explode(per_axis[0]).alias("a"), per_axis[1].alias("bs"), per_axis[2].alias("cs"))
    taps = taps.select("vol_id", "i", "j", "k", "a", F.explode("bs").alias("b"), "cs").select("vol_id", "i", "j", "k", "a", "b", F.explode("cs").alias("c"))
    taps = taps.select("vol_id", "i", "j", "k", F.col("a.p").alias("_i"), F.col("b.p").alias("_j"), F.col("c.p").alias("_k"), (F.col("a.w") * F.col("b.w") * F.col("c.w")).alias("w")).where("w <> 0")
    sums = taps.join(source, keys).groupBy("vol_id", "i", "j", "k").agg(F.sum(F.col("w") * F.col("_v")).alias("value"))
    made = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    return grid.join(sums, ["vol_id", "i", "j", "k"], "left").select("vol_id", "i", "j", "k", made.alias("value"))


def grow(volumes: DataFrame, dim: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """Voxels (vol_id, i, j, k) that a box of the given sizes around a set voxel reaches."""
    spans = []
    for m in sizes:
        lead = -(-m // 2) - 1
        spans.append(F.sequence(F.lit(-lead), F.lit(m - 1 - lead)))
    d = volumes.where("value > 0").select("vol_id", *(F.explode(spans[0]).alias("a") if c == "a" else F.col(c) for c in ("i", "j", "k", "a")))
    d = d.select("vol_id", (F.col("i") + F.col("a")).alias("i"), "j", "k").distinct()
    d = d.select("vol_id", "i", "j", "k", F.explode(spans[1]).alias("a")).select("vol_id", "i", (F.col("j") + F.col("a")).alias("j"), "k").distinct()
    d = d.select("vol_id", "i", "j", "k", F.explode(spans[2]).alias("a")).select("vol_id", "i", "j", (F.col("k") + F.col("a")).alias("k")).distinct()
    inside = F.lit(True)
    for c, n in zip("ijk", dim):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return d.where(inside)


def convolve(volumes: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Same-size convolution with a small kernel: each voxel spreads to its neighbours, which are summed map-side first."""
    lead = [-(-m // 2) - 1 for m in kernel.shape]
    taps = F.array(*(F.struct(*(F.lit(int(x - o)).alias(n) for x, o, n in zip(idx, lead, "abc")), F.lit(float(w)).alias("w")) for idx, w in np.ndenumerate(kernel) if w))
    spread = volumes.select("vol_id", "i", "j", "k", "value", F.explode(taps).alias("t")).groupBy("vol_id", (F.col("i") + F.col("t.a")).alias("i"), (F.col("j") + F.col("t.b")).alias("j"), (F.col("k") + F.col("t.c")).alias("k")).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return volumes.select("vol_id", "i", "j", "k").join(spread, ["vol_id", "i", "j", "k"])


def fill_surface(v: DataFrame, f: DataFrame, **options) -> DataFrame:
    """(mesh_id, i, j, k) of the voxels inside a mesh, and the voxel-to-RAS matrix by rows."""
    from voxelwave.operators.mesh import per_mesh

    def run(_, vs, fs):
        vol, m = K.fill_surface(vs, fs, **options)
        i, j, k = np.nonzero(vol)
        return {"i": i, "j": j, "k": k, "vox2ras": [m.reshape(-1).tolist()] * len(i)}

    return per_mesh(v, f, run, "i int, j int, k int, vox2ras array<double>")


REGISTRATION = "pair_id long, type string, transform array<double>, cost double, correlation_before double, correlation_after double"


#: Columns that a pair may have beside its volumes.
PAIR_COLUMNS = ("fixed_vox2ras", "moving_vox2ras", "mask", "fixed_points", "moving_points")


def register(pairs: DataFrame, dim: Sequence[int], kind: str = "rigid", moving_dim: Sequence[int] | None = None, **options) -> DataFrame:
    """Registers volumes pair by pair (pair_id, fixed array<double>, moving array<double>, both flattened by rows).

    Optional columns: ``fixed_vox2ras`` and ``moving_vox2ras`` (16 numbers by rows, else the identity), ``mask`` over the fixed
    volume, ``fixed_points`` and ``moving_points`` (landmarks, three numbers each, in RAS). ``transform`` maps fixed RAS to moving
    RAS, by rows.
    """
    import pyarrow as pa

    ship(pairs.sparkSession)
    extra = [c for c in PAIR_COLUMNS if c in pairs.columns]
    shapes = {"fixed": tuple(dim), "moving": tuple(moving_dim or dim), "mask": tuple(dim), "fixed_vox2ras": (4, 4), "moving_vox2ras": (4, 4), "fixed_points": (-1, 3), "moving_points": (-1, 3)}
    names = ["pair_id", "fixed", "moving", *extra]

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: np.asarray(b.column(k)[r].values.to_numpy(zero_copy_only=False), float).reshape(shapes[n]) for k, n in enumerate(names) if k and b.column(k)[r].is_valid}
                more = {"mask": row["mask"]} if "mask" in row else {}
                if "fixed_points" in row and "moving_points" in row:
                    more["points"] = (row["fixed_points"], row["moving_points"])
                f, m = row["fixed"], row["moving"]
                a, c = row.get("fixed_vox2ras", np.eye(4)), row.get("moving_vox2ras", np.eye(4))
                out = K.register(f, m, a, c, kind=kind, **options, **more)
                before = K.resample(m, f.shape, c, a, "trilinear", 0.0)
                corr = lambda u, v: float(np.corrcoef(u.ravel(), v.ravel())[0, 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1).cast(pa.int64()), pa.array([kind]), pa.array([out["transform"].reshape(-1).tolist()]), pa.array([float(out["cost"])]), pa.array([corr(f, before)]), pa.array([corr(f, out["warped"])])], ["pair_id", "type", "transform", "cost", "correlation_before", "correlation_after"])

    return pairs.select(*names).mapInArrow(run, REGISTRATION)
