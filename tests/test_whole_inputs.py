"""Queries and kernels take all rows that they are given."""

import numpy as np
from pyspark.sql import functions as F

from voxelwave.functions import evoked as EV
from voxelwave.functions import mesh as K
from voxelwave.operators import mesh as M
from voxelwave.operators import tensor as T
from voxelwave.plans import evoked_queries, registry
from voxelwave.runtime import table

SF = "/root/testdata/sf0.001"


def test_evoked_queries_take_every_embedding(spark):
    e = table(spark, SF, "embeddings")
    want = {r["label"]: r["count"] for r in e.groupBy("label").count().collect()}
    got = evoked_queries.trials(spark, SF).groupBy("ch").agg(F.countDistinct("trial").alias("n")).collect()
    assert {r.ch: r.n for r in got} == want and len(set(want.values())) > 1
    rows = e.collect()
    cube = np.full((10, 64, max(want.values())), np.nan)
    for label in want:
        for k, r in enumerate(sorted((r for r in rows if r.label == label), key=lambda r: r.vec_id)):
            cube[label, :, k] = r.embedding
    out = EV.carla(cube)
    carla = {r.ch: r for r in registry.queries()["carla"](spark, SF).collect()}
    assert [carla[k]["rank"] for k in range(10)] == (np.argsort(out["order"]) + 1).tolist()
    assert np.allclose([carla[k].score for k in range(10)], out["score"], atol=1e-6) and {r["size"] for r in carla.values()} == {out["size"]}
    shapes = {r.ch: r for r in registry.queries()["crp"](spark, SF).collect()}
    plain = {k: EV.crp(cube[k][:, : want[k]], np.arange(64) / 64, 0.0, 1.0) for k in want}
    assert all(shapes[k].n_trials == want[k] - len(plain[k]["artifacts"]) for k in want)
    flat = np.concatenate([cube[k][:, : want[k]] for k in range(10)], 1)
    weights = {r["group"]: r for r in EV.bpc(flat, np.repeat(np.arange(10), [want[k] for k in range(10)]), 3)["statistics"]}
    curves = {r.grp: r for r in registry.queries()["bpc"](spark, SF).collect()}
    assert set(curves) == set(weights) and all(np.isclose(curves[k].t, weights[k]["t"], atol=1e-5) for k in weights)


def test_sums_over_pairs_equal_the_pairs():
    r = np.random.default_rng(1)
    for n, times in ((7, 40), (30, 12)):
        v = np.sin(np.arange(times))[:, None] * r.uniform(0.2, 1, n) + r.normal(size=(times, n))
        s = EV.cross_projections(v)
        every, free = EV.pair_sums(EV.units(v), v, block=4)
        picked = s[EV.independent_pairs(n)]
        assert np.isclose(EV.mean_projection(v), s.mean())
        assert np.allclose(EV.moments(*free[0].sum(1)), (len(picked), picked.mean(), picked.var(ddof=1)))
        assert np.allclose(every.sum(0)[1].sum(), 2 * s.sum())
        w, e = np.linalg.eigh(v @ v.T)
        assert np.isclose(abs(EV.kernel_pca(v)[0][:, 0] @ e[:, -1]), 1)
        groups = np.array_split(np.arange(n), 3)
        assert np.allclose(EV.significance_by_moments(v, groups), EV.significance(EV.units(v).T @ v, groups))


def test_crp_drops_the_same_trials_as_by_pairs():
    r = np.random.default_rng(2)
    time = np.arange(60) / 60
    v = np.sin(2 * np.pi * time)[:, None] * r.uniform(0.8, 1.2, 24) + 0.3 * r.normal(size=(60, 24))
    v[:, 5] *= -1
    n, p = 24, EV.units(v).T @ v
    off = ~np.eye(n, dtype=bool)
    free = np.zeros((n, n), bool)
    flat = np.zeros(n * n - n, bool)
    flat[EV.independent_pairs(n)] = True
    free[off] = flat
    bad = []
    for k in range(n):
        own = np.concatenate([p[k][off[k]], p[:, k][off[:, k]]])
        rest = free.copy()
        rest[k] = rest[:, k] = False
        t, pv = EV.welch_test(own, p[rest])
        if pv < 1e-5 and t < 0 and own.mean() <= 0:
            bad.append(k)
    assert bad == [5] and EV.crp(v, time, 0.0, 1.0)["artifacts"].tolist() == bad


def test_carla_with_unequal_trials():
    x = np.random.default_rng(4).normal(size=(5, 30, 8))
    x[3, :, 5:] = np.nan
    out = EV.carla(x, 20)
    pairs = np.cov(x[3, :, :5].T)
    assert np.isclose(out["score"][3], pairs[np.triu_indices(5, 1)].mean()) and np.isfinite(out["curve"]).all()
    rare = x.copy()
    rare[0, :, 1:] = np.nan
    assert np.isfinite(EV.carla(rare, 20)["curve"]).all()


def test_catmull_rom_passes_through_every_embedding(spark):
    got = {}
    for r in registry.queries()["catmull_rom"](spark, SF).collect():
        got[r.vec_id, r.step] = (r.x, r.y, r.z)
    curves = {}
    for r in sorted(table(spark, SF, "embeddings").collect(), key=lambda r: r.vec_id):
        curves.setdefault(r.label, []).append((r.vec_id, r.embedding[:3]))
    assert len(got) == 16 * sum(len(c) - 1 for c in curves.values())
    for c in curves.values():
        ids, points = zip(*c)
        spans = len(ids) - 1
        want = K.catmull_rom(np.array(points, float), np.arange(16 * spans) / (16 * spans))
        assert np.allclose([got[ids[i // 16], i % 16] for i in range(16 * spans)], want, atol=2e-6)


def test_all_components(spark):
    x = np.array([r.embedding for r in table(spark, SF, "embeddings").collect()], float)
    cov = {(r.c1, r.c2): r["cov"] for r in registry.queries()["cov_matrix"](spark, SF).collect()}
    want = np.cov(x.T)
    assert len(cov) == 64 * 64 and all(abs(cov[i, j] - want[i, j]) < 2e-9 for i, j in cov)
    high = {r.c: r.value for r in registry.queries()["mv_quantile_p90"](spark, SF).collect()}
    s, h = np.sort(x, 0), (len(x) + 1) * 0.9
    k = int(h)
    assert h != k and len(high) == 64 and np.allclose([high[c] for c in range(64)], 0.9 * s[k - 1] + 0.1 * s[k], atol=1e-6)


def test_knn_of_every_point(spark):
    x = {r.vec_id: r.embedding[:3] for r in table(spark, SF, "embeddings").collect()}
    got = {}
    for r in registry.queries()["knn_3"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.target_id
    ids, p = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    assert set(got) == set(x) and all([got[i][k] for k in (1, 2, 3)] == ids[np.argsort(row, kind="stable")[:3]].tolist() for i, row in zip(ids, d))


def test_knn_ties_go_by_index():
    t = np.random.default_rng(6).integers(0, 3, (300, 3)).astype(float)
    t[7] = np.nan
    d, i = K.knn(t, t[:50], 9)
    want = np.argsort(((t[:50, None] - t[None]) ** 2).sum(2), axis=1, kind="stable")[:, :9]
    assert (i == want).all() and K.knn(t[:2], t[:4], 9)[1].shape == (4, 2)


def test_closed_curves(spark):
    p = np.random.default_rng(3).normal(size=(6, 3))
    df = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(p)] + [(1, 0, 0.0, 0.0, 0.0)], "curve int, k int, x double, y double, z double")
    for kind in ("centripetal", "chordal", "uniform"):
        got = {(r.k, r.step): (r.x, r.y, r.z) for r in M.catmull_rom(df, ["curve"], "k", 8, kind, closed=True).where("curve = 0").collect()}
        want = K.catmull_rom(p, np.arange(48) / 48, kind, closed_=True)
        assert np.allclose([got[i // 8, i % 8] for i in range(48)], want)


def test_quantiles_of_large_groups(spark, monkeypatch):
    """Brackets by a sketch give the same as ranking whole groups."""
    monkeypatch.setattr(T, "RANKED_WHOLE", 100)
    r = np.random.default_rng(5)
    groups = {0: r.normal(size=30_000), 1: np.repeat([1.0, 2.0], [5000, 9000]), 2: r.integers(0, 50, 12_345).astype(float), 3: np.arange(7.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(3, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(8)
    med = {x.g: x.value for x in T.median(df, ["g"]).collect()}
    assert med[4] is None and all(med[g] == np.median(x) for g, x in groups.items())
    for p in (0.001, 0.25, 0.5, 0.9, 0.999):
        got = {x.g: x.value for x in T.quantile(df, ["g"], p).collect()}
        for g, x in groups.items():
            s, h = np.sort(x), (len(x) + 1) * p
            k = int(h)
            want = s[max(k, 1) - 1] if h == k or h < 1 else s[-1] if k >= len(s) else p * s[k - 1] + (1 - p) * s[k]
            assert np.isclose(got[g], want), (p, g)


def test_rays_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "RAY_BLOCK", 16)
    r = np.random.default_rng(9)
    vs, fs = K.icosphere(2)
    o, d = r.normal(size=(60, 3)) * 3, r.normal(size=(60, 3))
    d[::2] = -o[::2] + 0.2 * d[::2]
    want = K.raycast(vs, fs, o, d)
    v, f = M.from_arrays(spark, {0: (vs, fs)})
    rays = spark.createDataFrame([(0, k, *map(float, o[k]), *map(float, d[k])) for k in range(60)], "mesh_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {x.ray_id: x for x in M.raycast(v, f, rays).collect()}
    assert len(got) == 60 and np.isfinite(want["distance"]).sum() > 20
    for k in range(60):
        assert (got[k].distance is None) == np.isnan(want["distance"][k])
        if got[k].distance is not None:
            assert np.allclose([got[k].distance, got[k].px, got[k].py, got[k].pz, got[k].nx, got[k].ny, got[k].nz], [want["distance"][k], *want["point"][k], *want["normal"][k]], atol=1e-9)
