"""Evoked-response operators: one contact, or one set of channels, a group; Gram matrices by grouping where they can be."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.functions import evoked as K
from voxelwave.runtime import cut, ship


def _cube(t: pa.Table, dims: Sequence[str], value: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A dense array from long rows, NaN where there is none, and the labels of each dimension."""
    labels, places = [], []
    for d in dims:
        u, p = np.unique(t.column(d).to_numpy(zero_copy_only=False), return_inverse=True)
        labels.append(u)
        places.append(p)
    out = np.full([len(u) for u in labels], np.nan)
    out[tuple(places)] = t.column(value).to_numpy()
    return out, labels


def trial_covariance(df: DataFrame, value: str = "value") -> DataFrame:
    """(ch, score): mean covariance between trials, natively, from sums over trials: no pair of trials is formed.

    With centred trials c, the sum over all pairs of c_i . c_j is |sum c|^2 - sum |c|^2.
    """
    mean = df.groupBy("ch", "trial").agg(F.avg(value).alias("_m"))
    c = df.join(mean, ["ch", "trial"]).withColumn("_c", F.col(value) - F.col("_m"))
    at = c.groupBy("ch", "t").agg(F.sum("_c").alias("s"), F.sum(F.col("_c") * F.col("_c")).alias("q"), F.count(F.lit(1)).alias("n"))
    g = at.groupBy("ch").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"), F.count(F.lit(1)).alias("nt"))
    return g.select("ch", ((F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1)) / (F.col("nt") - 1)).alias("score"))


def carla(df: DataFrame, by: Sequence[str], value: str = "value", **options) -> DataFrame:
    """(by, ch, rank, score, chosen, size) of recordings in long form (by, ch, t, trial, value); one recording a group."""
    ship(df.sparkSession)

    def run(key, t):
        x, (ch, _, _) = _cube(t, ["ch", "t", "trial"], value)
        r = K.carla(x, **options)
        rank = np.empty(len(ch), int)
        rank[r["order"]] = np.arange(1, len(ch) + 1)
        cols = {n: [k.as_py()] * len(ch) for n, k in zip(by, key)}
        return pa.table({**cols, "ch": pa.array(ch.astype(np.int64)), "rank": pa.array(rank, pa.int32()), "score": r["score"], "chosen": np.isin(np.arange(len(ch)), r["channels"]), "size": pa.array([r["size"]] * len(ch), pa.int32())}, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by) + "ch long, rank int, score double, chosen boolean, size int"
    kinds = to_arrow_schema(_parse_datatype_string(ddl))
    return df.groupBy(*by).applyInArrow(run, ddl)


#: Contacts whose shapes may come to the driver to be clustered: recordings have some hundreds.
MOST_CONTACTS = 20_000
CRP = "tau double, tau_low double, tau_high double, t_at_tau double, p_at_tau double, t_full double, p_full double, n_trials int, artifacts array<int>, shape array<double>, alpha array<double>, alpha_prime array<double>, snr array<double>, explained array<double>, profile_end array<double>, profile array<double>"


def crp(df: DataFrame, by: Sequence[str], time: str = "time", trial: str = "trial", value: str = "value", **options) -> DataFrame:
    """One nested row a contact from long rows (by, time, trial, value)."""
    ship(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by) + CRP
    kinds = to_arrow_schema(_parse_datatype_string(ddl))

    def run(key, t):
        x, (times, _) = _cube(t, [time, trial], value)
        r = K.crp(x, times, pairs=False, **options)
        row = {n: k.as_py() for n, k in zip(by, key)}
        row |= {k: float(r[k]) for k in ("tau", "tau_low", "tau_high", "t_at_tau", "p_at_tau", "t_full", "p_full")}
        row |= {"n_trials": len(r["trials"]), "artifacts": r["artifacts"].tolist(), "shape": r["C"].tolist()} | {k: r[k].tolist() for k in ("alpha", "alpha_prime", "snr", "explained", "profile_end", "profile")}
        return pa.Table.from_pylist([row], kinds)

    return df.groupBy(*by).applyInArrow(run, ddl)


def cosine_matrix(df: DataFrame, id_col: str, samples: str = "samples", block: int = 2048) -> DataFrame:
    """(a, b, cosine) of all pairs of equally long arrays (contacts, shapes): the matrix itself is the result.

    Arrays are dealt into blocks of bounded size, and every pair of blocks is a group of its own.
    """
    ship(df.sparkSession)
    x = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(samples).cast("array<double>").alias("x")), "shapes")
    n = max(1, -(-x.count() // block))
    deal = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = x.select("id", "x", deal.alias("i"), others.alias("j")), x.select(F.col("id").alias("to"), F.col("x").alias("y"), others.alias("k"), deal.alias("l"))

    def unit(t, name):
        m = np.stack([np.asarray(v.values) for v in t.column(name)])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(key, s, t):
        if not s.num_rows or not t.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        a, b = np.meshgrid(s.column("id").to_numpy(), t.column("to").to_numpy(), indexing="ij")
        return pa.table({"a": a.ravel(), "b": b.ravel(), "cosine": (unit(s, "x") @ unit(t, "y").T).ravel()})

    return left.groupBy("i", "j").cogroup(right.groupBy("k", "l")).applyInArrow(run, "a long, b long, cosine double")


def group_significance(df: DataFrame, id_col: str, group: str, samples: str = "samples") -> DataFrame:
    """(g1, g2, xi): mean / (sd / sqrt n) of the projections between trials of groups.

    Sums and sums of squares over all pairs come from moments: with unit trials u and trials v, the sum over i, j of u_i . v_j
    is U . V, and that of squares is <sum u u', sum v v'>; so no pair of trials is formed, only one matrix a group.
    """
    ship(df.sparkSession)

    names = ("u", "v", "uu", "vv", "own")

    def moments(batches):
        """One row a batch and group."""
        for b in batches:
            groups = b.column(0).to_numpy(zero_copy_only=False)
            rows = [np.asarray(v.values, float) for v in b.column(1)]
            out: dict[str, list] = {n: [] for n in ("g", "n", *names)}
            for g in np.unique(groups).tolist():
                x = np.stack([rows[i] for i in np.flatnonzero(groups == g).tolist()])
                n = np.linalg.norm(x, axis=1, keepdims=True)
                u = x / np.where(n == 0, 1, n)
                own = (u * x).sum(1)
                for k, v in zip(out, (g, len(x), u.sum(0), x.sum(0), (u.T @ u).ravel(), (x.T @ x).ravel(), [own.sum(), (own**2).sum()])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["g"], pa.int64()), pa.array(out["n"], pa.int64()), *(pa.array([list(v) for v in out[n]], pa.list_(pa.float64())) for n in names)], ["g", "n", *names])

    def add(key, t):
        sums = [np.sum([np.asarray(v.values) for v in t.column(n)], axis=0).tolist() for n in names]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([sum(t.column("n").to_pylist())], pa.int64()), *(pa.array([v], pa.list_(pa.float64())) for v in sums)], ["g", "n", *names])

    schema = "g long, n long, u array<double>, v array<double>, uu array<double>, vv array<double>, own array<double>"
    parts = df.where(F.col(group).isNotNull() & F.col(samples).isNotNull()).select(F.col(group).cast("long").alias("g"), F.col(samples).cast("array<double>").alias("x")).mapInArrow(moments, schema)
    # a hot group's parts are added in two steps
    m = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("g", "salt").applyInArrow(add, schema).groupBy("g").applyInArrow(add, schema)
    m = cut(m.select("g", "n", "u", "v", "uu", "vv", F.get("own", F.lit(0)).alias("d"), F.get("own", F.lit(1)).alias("dd")), "moments")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, w: s + w)
    a = m.select(F.col("g").alias("g1"), F.col("n").alias("n1"), "u", "uu", "d", "dd")
    b = m.select(F.col("g").alias("g2"), F.col("n").alias("n2"), "v", "vv")
    # one row a group on either side; the result itself has a row a pair of groups
    p = a.crossJoin(b)
    own = F.col("g1") == F.col("g2")
    n = F.col("n1") * F.col("n2") - F.when(own, F.col("n1")).otherwise(0)
    s = dot(F.col("u"), F.col("v")) - F.when(own, F.col("d")).otherwise(0.0)
    q = dot(F.col("uu"), F.col("vv")) - F.when(own, F.col("dd")).otherwise(0.0)
    sd = F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    return p.select("g1", "g2", F.when(sd > 0, s / n / (sd / F.sqrt(n))).otherwise(F.lit(0.0)).alias("xi"))


def bpc(df: DataFrame, by: Sequence[str], group: str = "grp", time: str = "t", trial: str = "trial", value: str = "value", **options) -> DataFrame:
    """(by, grp, curve, weight, snr, t, p, rank) of basis profile curves; one recording a group of rows."""
    ship(df.sparkSession)
    ddl = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by) + "grp long, curve int, weight double, snr double, t double, p double, rank int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(ddl))

    def run(key, t):
        x, (_, trials) = _cube(t, [time, trial], value)
        first = np.unique(t.column(trial).to_numpy(), return_index=True)[1]
        r = K.bpc(x, t.column(group).to_numpy()[first].tolist(), **options)
        head = {n: k.as_py() for n, k in zip(by, key)}
        return pa.Table.from_pylist([head | {"grp": s["group"], "curve": s["curve"], "weight": s["weight"], "snr": s["snr"], "t": s["t"], "p": s["p"], "rank": r["rank"]} for s in r["statistics"]], kinds)

    return df.groupBy(*by).applyInArrow(run, ddl)


def nmf(df: DataFrame, by: Sequence[str], row: str, col: str, k: int, value: str = "value", **options) -> DataFrame:
    """(by, factor, kind, index, value) of small matrices in long form, one a group."""
    ship(df.sparkSession)
    ddl = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by) + "factor int, kind string, index long, value double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(ddl))

    def run(key, t):
        x, (rows, cols) = _cube(t, [row, col], value)
        r = K.nmf(np.nan_to_num(x), k, **options)
        out = [(f, "w", int(i), float(v)) for f in range(k) for i, v in zip(rows, r["w"][:, f])] + [(f, "h", int(i), float(v)) for f in range(k) for i, v in zip(cols, r["h"][f])]
        head = [[c.as_py()] * len(out) for c in key]
        return pa.table([pa.array(c, f.type) for c, f in zip([*head, *map(list, zip(*out))], kinds)], schema=kinds)

    return df.groupBy(*by).applyInArrow(run, ddl)


def crp_cluster(spark, contacts: DataFrame, by: str, time: str = "time", trial: str = "trial", value: str = "value", n: int | None = None, crp_options: dict | None = None, **options) -> DataFrame:
    """(contact, cluster, fitness): shapes are found contact by contact on executors; the table of at most MOST_CONTACTS is clustered."""
    full = cut(crp(contacts, [by], time, trial, value, **(crp_options or {})).select(by, "shape"), "shapes")
    if full.count() > MOST_CONTACTS:
        raise ValueError(f"at most {MOST_CONTACTS} contacts can be clustered together")
    rows = sorted(full.collect(), key=lambda r: r[0])
    out = K.crp_cluster([{"C_full": np.asarray(r["shape"])} for r in rows], paired=False, n=n, **options)
    return spark.createDataFrame([(r[0], int(c), float(f)) for r, c, f in zip(rows, out["assignment"], out["fitness"])], f"{by} long, cluster int, fitness double")
