"""Operator 7: exact top-k inner-product search with dual cover trees.

Vectors and queries are dealt into blocks of bounded size, near ones together: by the nearest of a few pivots, then by a hash.
Each block is indexed once by a cover tree, and written. A cover tree has levels of centres with scales that halve: the centres
of a level are farther apart than its scale (separation), are centres of all finer levels too (nesting), and each centre of the
next level is within the scale of its parent (covering). Farthest-first insertion gives all levels at once: a point is a centre
from the first level whose scale its insertion distance exceeds.

The largest score of a pair of nodes is ``c_q . c_x + |c_q| r_x + r_q |c_x| + r_q r_x`` with centres c and covering radii r. The
same bound over the blocks' roots comes first: every query block meets the vector block of its best bound, which gives each query
a k-th score; only block pairs whose bound reaches the worst of these scores are brought together at all. Within a pair both
trees are descended together, best bound first; a node pair below the worst k-th score of its query group is pruned, so are
single vectors of a leaf; the rest is scored exactly.

Components are integers. Scores are exact: by double products where all sums stay below 2**53, by 64-bit integers up to 2**63;
larger ones could not be returned as a long and raise a ValueError. Ties go to the smaller id everywhere.

Cases: null and empty vectors, vectors with null or non-finite components and rows without an id take no part. A vector is
compared with those of the same length. A query never meets rows with its own id; repeated rows are separate candidates with equal
scores. All rows of a query id take part and are ranked together. Fewer than k candidates: all of them. An empty table gives an
empty table. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelwave.llm.rows import FEW, pick
from voxelwave.runtime import cut, drop, ship

#: Vectors and queries that a block should hold, fewer if they are long; points of a leaf.
BLOCK, QUERY_BLOCK = 4096, 1024
BLOCK_BYTES = 4 << 20
LEAF = 128
#: Rows of least hash that deal the others; any choice gives the same result.
PIVOTS = 64
#: Query blocks that meet one copy of a vector block; block roots that are compared in one group.
FAN = 16
ROOTS = 4096
#: Pairs of blocks that are searched without a first pass over their bounds.
FEW_PAIRS = 64
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- trees


def cover_levels(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Level and parent of each point, and the root's scale; level i has scale ``scale / 2**i``, the root is its own parent.

    Levels end when no centre has more than ``leaf`` points near it; all others are then on one last level.
    """
    n = len(x)
    sq = (x * x).sum(1)
    root = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    near = np.maximum(sq + sq[root] - 2 * (x @ x[root]), 0)
    near[root] = 0
    which = np.full(n, root)
    top = float(near.max())
    level = np.zeros(n, np.int64)
    i = 1
    while n > 1:
        p = int(np.argmax(near))
        if near[p] <= top / 4**i:
            if near[p] <= 0 or np.bincount(which).max() <= leaf:
                break
            i += 1
            continue
        level[p] = i
        d = sq + sq[p] - 2 * (x @ x[p])
        closer = d < near
        near[closer], which[closer] = d[closer], p
        near[p], which[p] = 0, p
    done = level > 0
    done[root] = True
    level[~done] = int(level.max()) + 1
    parent = np.arange(n)
    for i in range(1, int(level.max()) + 1):
        new, centres = np.flatnonzero(level == i), np.flatnonzero(level < i)
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            parent[part] = centres[np.argmin(sq[centres] - 2 * (x[part] @ x[centres].T), axis=1)]
    return level, parent, float(np.sqrt(top))


class CoverTree:
    """Nodes over rows in tree order: spans, centres, covering radii. Children of a node are consecutive nodes.

    Neighbouring children that are small share a leaf of at most ``leaf`` points.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        level, parent, _ = cover_levels(x, leaf)
        depth = int(level.max())
        above = []
        for i in range(depth + 1):
            a = np.arange(len(x))
            for j in range(i + 1, depth + 1):
                at = level == j
                a[at] = a[parent[at]]
            above.append(a)
        self.order = np.lexsort(above[::-1])
        x = x[self.order]
        paths = [a[self.order] for a in above]
        where = np.empty(len(x), np.int64)
        where[self.order] = np.arange(len(x))
        nodes = [[int(where[paths[0][0]]), 0, len(x), 0, 0]]
        at_level = [0]
        k = 0
        while k < len(nodes):
            _, a, b, _, _ = nodes[k]
            here = at_level[k]
            if here >= 0 and b - a > leaf:
                runs = np.zeros(0, np.int64)
                while here < depth and not len(runs):
                    here += 1
                    runs = np.flatnonzero(np.diff(paths[here][a:b])) + a + 1
                bounds = [a, *runs.tolist(), b]
                nodes[k][3] = len(nodes)
                lo = 0
                while lo + 1 < len(bounds):
                    hi = lo + 1
                    while hi + 1 < len(bounds) and bounds[hi + 1] - bounds[lo] <= leaf:
                        hi += 1
                    nodes.append([int(where[paths[here][bounds[lo]]]), bounds[lo], bounds[hi], 0, 0])
                    at_level.append(here if hi == lo + 1 else -1)
                    nodes[k][4] += 1
                    lo = hi
            k += 1
        self.nodes = np.array(nodes, np.int32)
        self.radius = np.array([np.sqrt(((x[a:b] - x[c]) ** 2).sum(1).max()) for c, a, b, _, _ in nodes])


class Tree:
    """A block as it is written: vectors and ids in tree order with their nodes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.ids, self.rows, self.radius = ids, rows, radius
        self.x = rows.astype(float)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.center = self.x[nodes[:, 0]]
        self.length = self.norm[nodes[:, 0]]
        self.span = [slice(a, b) for a, b in nodes[:, 1:3].tolist()]
        self.children = [range(f, f + n) for f, n in nodes[:, 3:].tolist()]

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        t = CoverTree(rows.astype(float), leaf)
        return cls(ids[t.order], rows[t.order], t.nodes, t.radius)


# ---------------------------------------------------------------- search in a pair of blocks


class Best:
    """The k best (score, smaller id) of each query; ``floor`` are scores that k rows elsewhere reach already."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), _LAST)
        self.floor = np.full(n, _NONE) if floor is None else floor

    def bar(self, rows: slice) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        bar = self.bar(rows)
        if scores.shape[1] > self.k:
            # all that reach the k-th largest new score, ties included, can matter
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        keep = scores >= bar[:, None]
        width = int(keep.sum(1).max(initial=0))
        if width == 0:
            return
        chosen = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        kept = np.where(np.take_along_axis(keep, chosen, 1), np.take_along_axis(scores, chosen, 1), _NONE)
        s = np.concatenate([self.score[rows], kept], 1)
        i = np.concatenate([self.id[rows], np.where(kept == _NONE, _LAST, ids[chosen])], 1)
        order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)


def dual_search(q: Tree, x: Tree, k: int, floor: np.ndarray | None = None) -> Best:
    """Exact k best rows of ``x`` for each row of ``q``, by one descent of both trees."""
    best = Best(len(q.ids), k, floor)
    limit = float(np.abs(q.x).max(initial=0)) * float(np.abs(x.x).max(initial=0)) * q.x.shape[1]
    left, right = (q.x, x.x) if limit < 2**53 else (q.rows, x.rows)
    # more than the rounding of bounds and sums
    slack = 1e-9 * (1 + (q.length.max() + q.radius.max()) * (x.length.max() + x.radius.max()))

    def bounds(i: int, j: np.ndarray) -> np.ndarray:
        return x.center[j] @ q.center[i] + q.length[i] * x.radius[j] + q.radius[i] * x.length[j] + q.radius[i] * x.radius[j] + slack

    heap = [(-np.inf, 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        rows = q.span[i]
        worst = float(best.bar(rows).min())
        if -bound < worst:
            continue
        if not q.children[i] and not x.children[j]:
            # single vectors that no query of the group can want are left out
            cols = np.arange(x.span[j].start, x.span[j].stop)
            cols = cols[x.x[cols] @ q.center[i] + q.radius[i] * x.norm[cols] + slack >= worst]
            if len(cols):
                scores = (left[rows] @ right[cols].T).astype(np.int64)
                scores[q.ids[rows][:, None] == x.ids[cols][None, :]] = _NONE
                best.offer(rows, scores, x.ids[cols])
            continue
        split_q = q.children[i] and (not x.children[j] or q.radius[i] > x.radius[j])
        nodes = np.array([j]) if split_q else np.array(x.children[j])
        for a in q.children[i] if split_q else [i]:
            up = bounds(a, nodes)
            for c in np.flatnonzero(up >= float(best.bar(q.span[a]).min())).tolist():
                heapq.heappush(heap, (-float(up[c]), a, int(nodes[c])))
    return best


# ---------------------------------------------------------------- blocks

_BLOCKS = "side int, block string, dim int, center binary, radius double, ids binary, rows binary, nodes binary, radii binary"


def _chain(p: np.ndarray) -> list[int]:
    """Pivots in an order in which neighbours are near."""
    order, left = [0], list(range(1, len(p)))
    while left:
        d = ((p[left] - p[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return order


def _groups(sizes: dict[tuple[int, int, int], int], pivots: dict[int, np.ndarray], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(side, dim, pivot, group, tiles): neighbouring pivots share a group while a block holds them, large ones are dealt into tiles."""
    out = []
    for side, dim in sorted({k[:2] for k in sizes}):
        held, group = 0, -1
        for p in _chain(pivots[dim]) if dim in pivots else [0]:
            n = sizes.get((side, dim, p), 0)
            if group < 0 or held + n > limit[side]:
                held, group = 0, group + 1
            held += n
            out.append((side, dim, p, group, n))
    total: dict[tuple[int, int, int], int] = {}
    for side, dim, _, group, n in out:
        total[side, dim, group] = total.get((side, dim, group), 0) + n
    return [(side, dim, p, group, max(1, -(-total[side, dim, group] // limit[side]))) for side, dim, p, group, _ in out]


def blocks(df: DataFrame, limit: tuple[int, int], pivots: dict[int, np.ndarray], leaf: int = LEAF) -> tuple[DataFrame, list[int]]:
    """(side, id, vec) rows of vectors (side 0) and queries (side 1) to one row a block with its tree, written; and the blocks of each side."""

    def near(batches):
        for b in batches:
            vec = b.column(2)
            offsets = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            out = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    v = flat[offsets[at][:, None] + np.arange(d)]
                    p = pivots[d]
                    out[at] = np.argmin((p * p).sum(1) - 2 * (v @ p.T), axis=1)
            rows = [flat[a:b_].astype("<i8").tobytes() for a, b_ in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            most = np.maximum.reduceat(np.abs(flat[: offsets[-1]]), offsets[:-1]) if len(dims) else np.zeros(0)
            most = np.where(most < 2.0**62, most, 2.0**62).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(out), pa.array(most), pa.array(rows, pa.binary())], ["side", "id", "dim", "pivot", "most", "row"])

    def run(keys, t):
        ids = t.column("id").to_numpy()
        rows = np.frombuffer(b"".join(t.column("row").to_pylist()), "<i8").reshape(len(ids), -1)
        by = np.argsort(ids, kind="stable")
        ids, rows = ids[by], rows[by]
        tree = CoverTree(rows.astype(float), leaf)
        values = [keys[0].as_py(), keys[1].as_py(), rows.shape[1], rows[tree.order[tree.nodes[0, 0]]].tobytes(), float(tree.radius[0]), ids[tree.order].tobytes(), rows[tree.order].tobytes(), tree.nodes.tobytes(), tree.radius.tobytes()]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.float64(), *[pa.binary()] * 4]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], ["side", "block", "dim", "center", "radius", "ids", "rows", "nodes", "radii"])

    dealt = cut(df.mapInArrow(near, "side int, id long, dim int, pivot int, most long, row binary"), "dealt")
    # one row a side, vector length and pivot
    found = dealt.groupBy("side", "dim", "pivot").agg(F.count("*").alias("n"), F.max("most").alias("most")).collect()
    most = {(side, r.dim): max(x.most for x in found if (x.side, x.dim) == (side, r.dim)) for r in found for side in {x.side for x in found if x.dim == r.dim}}
    if any(m >= 1 << 62 or m * most.get((1, d), 0) * d >= 1 << 63 for (side, d), m in most.items()):
        raise ValueError("scores of these vectors do not fit a 64-bit integer")
    width = max((r.dim for r in found), default=1)
    rows = _groups({(r.side, r.dim, r.pivot): r.n for r in found}, pivots, [max(1, min(n, BLOCK_BYTES // (8 * width))) for n in limit])
    groups = df.sparkSession.createDataFrame(rows, "side int, dim int, pivot int, grp int, tiles int")
    # a row's place in the written table deals equal rows apart
    placed = dealt.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(groups) if len(rows) <= FEW else groups, ["side", "dim", "pivot"])
    named = placed.select("side", "id", "row", F.concat_ws(".", "dim", "grp", F.pmod(F.xxhash64("id", "at"), F.col("tiles"))).alias("block"))
    out = cut(named.groupBy("side", "block").applyInArrow(run, _BLOCKS), "blocks")
    drop(dealt)
    tiles = {r[:2] + r[3:] for r in rows}
    return out, [sum(t[-1] for t in tiles if t[0] == side) for side in (0, 1)]


def _tree(row: dict) -> Tree:
    ids = np.frombuffer(row["ids"], np.int64)
    return Tree(ids, np.frombuffer(row["rows"], np.int64).reshape(len(ids), -1), np.frombuffer(row["nodes"], np.int32).reshape(-1, 5), np.frombuffer(row["radii"]))


def _root_pairs(q: DataFrame, x: DataFrame, seeds: DataFrame | None, n_q: int, n_x: int) -> DataFrame:
    """(qb, xb, bound), roots dealt into n_q and n_x groups: for each query block the pair of best bound in each group; or, with ``seeds`` (qb, xb, worst), all
    pairs but those whose bound reaches ``worst``."""
    keep = seeds is not None
    stats = lambda t, n: t.select("block", "dim", "center", "radius").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    left = stats(q, n_q).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    if keep:
        left = left.join(seeds.select(F.col("qb").alias("block"), F.col("xb").alias("seed"), "worst"), "block")
    right = stats(x, n_x).withColumnRenamed("g", "h").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    empty = pa.table({"qb": pa.array([], pa.string()), "xb": pa.array([], pa.string()), "bound": pa.array([], pa.float64())})

    def run(keys, a, b):
        if not a.num_rows or not b.num_rows:
            return empty
        (qc, qr), (xc, xr) = ((np.array([np.frombuffer(v, np.int64) for v in t.column("center").to_pylist()], float), t.column("radius").to_numpy()) for t in (a, b))
        qn, xn = np.sqrt((qc**2).sum(1)), np.sqrt((xc**2).sum(1))
        up = qc @ xc.T + qn[:, None] * xr + qr[:, None] * xn + qr[:, None] * xr
        up += 1e-9 * (1 + (qn + qr)[:, None] * (xn + xr))
        qb, xb = np.array(a.column("block").to_pylist()), np.array(b.column("block").to_pylist())
        if keep:
            i, j = np.nonzero((up >= a.column("worst").to_numpy()[:, None]) & (np.array(a.column("seed").to_pylist())[:, None] != xb))
        else:
            i, j = np.arange(len(qb)), up.argmax(1)
        return pa.table({"qb": pa.array(qb[i], pa.string()), "xb": pa.array(xb[j], pa.string()), "bound": pa.array(up[i, j])})

    return left.groupBy("dim", "g", "h").cogroup(right.groupBy("dim", "g", "h")).applyInArrow(run, "qb string, xb string, bound double")


_FOUND = "qb string, xb string, place int, query_id long, vec_id long, score long"


def _meet(pairs: DataFrame, q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query within each pair of blocks; ``q`` may have ``floors``. A vector block goes to groups of FAN query blocks."""
    fans = pairs.groupBy("xb").agg(F.ceil(F.count("*") / F.lit(FAN)).alias("fans"))
    dealt = pairs.select("qb", "xb").join(fans, "xb").withColumn("fan", F.pmod(F.xxhash64("qb"), F.col("fans")))
    left = dealt.join(q.withColumnRenamed("block", "qb"), "qb").select("xb", "fan", "qb", "ids", "rows", "nodes", "radii", "floors")
    right = dealt.select(F.col("xb").alias("block"), F.col("fan").alias("part")).distinct().join(x, "block").select("block", "part", "ids", "rows", "nodes", "radii")

    def run(keys, a, b):
        (whole,) = b.to_pylist()
        tree = _tree(whole)
        parts = []
        for row in a.to_pylist():
            t = _tree(row)
            best = dual_search(t, tree, k, np.frombuffer(row["floors"], np.int64) if row["floors"] else None)
            at, col = np.nonzero(best.score > _NONE)
            parts.append(pa.table({"qb": pa.array([row["qb"]] * len(at), pa.string()), "xb": pa.array([whole["block"]] * len(at), pa.string()), "place": pa.array(at, pa.int32()), "query_id": t.ids[at], "vec_id": best.id[at, col], "score": best.score[at, col]}))
        return pa.concat_tables(parts)

    return left.groupBy("xb", "fan").cogroup(right.groupBy("block", "part")).applyInArrow(run, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, leaf: int = LEAF, roots: int = ROOTS, few: int = FEW_PAIRS) -> DataFrame:
    """query_id, rank, vec_id, score for integer vectors (id long, vec array<double>)."""
    spark = vectors.sparkSession
    ship(spark)
    clean = lambda df, side: pick(df, "id", "vec").where(F.col("id").isNotNull() & (F.size("vec") > 0)).select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), "vec")
    both = clean(vectors, 0).unionByName(clean(queries, 1))
    # a fixed number of rows
    pivots: dict[int, list] = {}
    for r in both.where("side = 0").orderBy(F.xxhash64("id"), "id", "vec").limit(PIVOTS).collect():
        pivots.setdefault(len(r.vec), []).append(r.vec)
    built, n = blocks(both, (block, query_block), {d: np.array(v) for d, v in pivots.items()}, leaf)
    # read twice, so that the two sides are told apart in joins
    xb, qb = (spark.read.schema(_BLOCKS).parquet(f"{built._cut_path}/t").where(F.col("side") == side).drop("side") for side in (0, 1))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    plain = qb.withColumn("floors", F.lit(None).cast("binary"))
    if n[0] * n[1] <= few:
        # so few pairs that bounds are not worth a pass of their own
        pairs = qb.select(F.col("block").alias("qb"), "dim", F.lit(0).alias("g")).join(F.broadcast(xb.select(F.col("block").alias("xb"), "dim", F.lit(0).alias("g"))), ["dim", "g"])
        return ranked(_meet(pairs.select("qb", "xb"), plain, xb, k))
    n = [max(1, -(-v // roots)) for v in n[::-1]]
    best = W.partitionBy("qb").orderBy(F.desc("bound"), "xb")
    seeds = cut(_root_pairs(qb, xb, None, *n).withColumn("r", F.row_number().over(best)).where("r = 1").select("qb", "xb"), "seeds")
    first = cut(_meet(seeds, plain, xb, k), "first")

    # the k-th score of each query, or none, and the worst of a query block
    def floors(keys, a, b):
        if not a.num_rows:
            return pa.table({"qb": pa.array([], pa.string()), "xb": pa.array([], pa.string()), "worst": pa.array([], pa.float64()), "floors": pa.array([], pa.binary())})
        row = a.to_pylist()[0]
        low = np.full(len(row["ids"]) // 8, _LAST)
        at = b.column("place").to_numpy()
        np.minimum.at(low, at, b.column("score").to_numpy())
        low[np.bincount(at, minlength=len(low)) < k] = _NONE
        return pa.table({"qb": [keys[0].as_py()], "xb": [row["xb"]], "worst": [float(low.min())], "floors": pa.array([low.tobytes()], pa.binary())})

    sized = seeds.join(qb.select(F.col("block").alias("qb"), "ids"), "qb")
    known = cut(sized.groupBy("qb").cogroup(first.select("qb", "place", "score").groupBy("qb")).applyInArrow(floors, "qb string, xb string, worst double, floors binary"), "floors")
    rest = cut(_root_pairs(qb, xb, known, *n), "pairs")
    later = _meet(rest, qb.join(known.select(F.col("qb").alias("block"), "floors"), "block"), xb, k)
    return ranked(first.unionByName(later))


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, vec): floor(scale * x) of each component; vectors with null or non-finite components go."""
    v = F.col("vec")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    # the floor of a double that is an integer already is itself; a long would saturate
    floor = lambda c: F.when(F.abs(c) < F.lit(2.0**52), F.floor(c).cast("double")).otherwise(c)
    return pick(df, id_col, vec_col).toDF("id", "vec").where(v.isNotNull() & ~bad).select("id", F.transform(v, lambda c: floor(c.cast("double") * scale)).alias("vec"))
