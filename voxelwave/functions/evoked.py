"""Evoked-response kernels in numpy: factorisation, reference selection, response shapes and their clusters."""

from __future__ import annotations

import math

import numpy as np

# ---------------------------------------------------------------- distributions


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    if not math.isfinite(t):
        return float(t > 0)
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - p if t > 0 else p


def t_test(x: np.ndarray, alternative: str = "greater") -> tuple[float, float]:
    """One sample against zero: (t, p)."""
    x = np.asarray(x, float)
    return t_of(len(x), x.mean() if len(x) else math.nan, x.var(ddof=1) if len(x) > 1 else math.nan, alternative)


def t_of(n: float, mean: float, var: float, alternative: str = "greater") -> tuple[float, float]:
    """The same from a sample's size, mean and variance."""
    if n < 2:
        return math.nan, math.nan
    sd = math.sqrt(var)
    t = mean / (sd / math.sqrt(n)) if sd > 0 else math.copysign(math.inf, mean) if mean else 0.0
    p = 1 - t_cdf(t, n - 1)
    return float(t), p if alternative == "greater" else 2 * min(p, 1 - p)


def welch_test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two samples of unequal variances: (t, two-sided p)."""
    return welch_of((len(x), x.mean(), x.var(ddof=1)), (len(y), y.mean(), y.var(ddof=1)))


def welch_of(x: tuple[float, float, float], y: tuple[float, float, float]) -> tuple[float, float]:
    """The same from (size, mean, variance) of each sample."""
    (n, mx, vx), (m, my, vy) = x, y
    vx, vy = vx / n, vy / m
    if vx + vy == 0:
        return 0.0, 1.0
    t = (mx - my) / math.sqrt(vx + vy)
    df = (vx + vy) ** 2 / (vx**2 / (n - 1) + vy**2 / (m - 1))
    return float(t), 2 * (1 - t_cdf(abs(t), df))


def moments(n, total, squares) -> tuple[float, float, float]:
    """(size, mean, variance) from sums."""
    return n, total / max(n, 1), max((squares - total * total / max(n, 1)) / max(n - 1, 1), 0.0)


# ---------------------------------------------------------------- factorisation


def nmf(x: np.ndarray, k: int, tol: tuple[float, float] = (1e-4, 1e-8), rounds: int = 10_000, seed: int = 0) -> dict:
    """x = w h, none negative: multiplicative updates, mixed 9 to 1 with the values before."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    w, h = rng.random((n, k)), rng.random((k, m))
    eps = np.finfo(float).eps
    for step in range(1, rounds + 1):
        w0, h0 = w, h
        h = h * (0.1 + 0.9 * (w.T @ x) / (w.T @ w @ h + eps))
        w = w * (0.1 + 0.9 * (x @ h.T) / (w @ (h @ h.T) + eps))
        moved = math.sqrt((np.sum((w - w0) ** 2) + np.sum((h - h0) ** 2)) / (w.size + h.size))
        left = np.abs(x - w @ h).max()
        if moved < tol[1] or left < np.abs(x).max() * tol[0]:
            break
    return {"w": w, "h": h, "iterations": step, "residual": float(np.sqrt(np.mean((x - w @ h) ** 2)))}


def zeta(h: np.ndarray) -> float:
    """How much the rows of a factor overlap: the largest off-diagonal product over unit rows, summed."""
    u = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    g = u @ u.T
    return float(g[np.triu_indices(len(h), 1)].sum())


def nmf_rank(x: np.ndarray, start: int, threshold: float = 1.0, tries: int = 5, **options) -> tuple[dict, int]:
    """The best of some restarts, with one factor less until the rows of h overlap by no more than the threshold."""
    k = min(start, min(x.shape))
    while True:
        best = min((nmf(x, k, seed=s, **options) for s in range(tries)), key=lambda r: r["residual"])
        if k <= 1 or zeta(best["h"]) <= threshold:
            return best, k
        k -= 1


# ---------------------------------------------------------------- CARLA


def _mean_pair_cov(x: np.ndarray) -> np.ndarray:
    """Mean covariance between trials for each channel of (channel, time, trial), over the trials that a channel has."""
    has = np.isfinite(x).all(1)
    c = np.where(has[:, None], x, 0)
    c = c - c.mean(1, keepdims=True)
    n = has.sum(1)
    own = (c**2).sum((1, 2))
    total = (c.sum(2) ** 2).sum(1) - own
    return np.where(n > 1, total / np.maximum(n * (n - 1), 1), own) / (x.shape[1] - 1)


def carla(x: np.ndarray, n_boot: int = 100, sensitive: bool = False, least: int | None = None, absolute: bool = False, indices: np.ndarray | None = None, seed: int = 0) -> dict:
    """Channels (channel, time, trial) for a common average: ranked by responsiveness, added until the least correlated
    channel of the set starts to agree too well or too badly with it.

    Channels need not have equally many trials: one that is not whole is NaN there and left out of that channel's means, its
    trials are drawn with those of the others, and a draw that leaves a channel without any is drawn again.
    """
    n_ch, _, n_tr = x.shape
    has = np.isfinite(x).all(1)
    if not has.any(1).all():
        raise ValueError("a channel has no whole trial")
    score = _mean_pair_cov(x)
    order = np.argsort(np.abs(score) if absolute else score, kind="stable")
    least = least or max(2, int(np.ceil(0.1 * n_ch)))
    if indices is None:
        rng = np.random.default_rng(seed)
        indices = rng.integers(0, n_tr, (n_boot, n_tr)) if n_tr > 1 else np.zeros((1, 1), int)
        while (void := ~has[:, indices].any(2).all(0)).any():
            indices[void] = rng.integers(0, n_tr, (int(void.sum()), n_tr))
    z = np.full((n_ch + 1, len(indices)), np.nan)
    whole = np.where(has[:, None], x, 0)
    boots = [whole[:, :, i].sum(2) / has[:, i].sum(1)[:, None] for i in indices]
    for size in range(2, n_ch + 1):
        group = order[:size]
        for b, m in enumerate(boots):
            g = m[group]
            ref = g - g.mean(0)
            ref_c, raw = ref - ref.mean(1, keepdims=True), g - g.mean(1, keepdims=True)
            norm_ref, norm_raw = np.linalg.norm(ref_c, axis=1), np.linalg.norm(raw, axis=1)
            r = (ref_c @ raw.T) / np.maximum(np.outer(norm_ref, norm_raw), 1e-300)
            np.fill_diagonal(r, 0)
            fz = np.arctanh(np.clip(r, -1 + 1e-12, 1 - 1e-12)).sum(1) / max(1, size - 1)
            z[size, b] = fz.min()
    mean = np.concatenate([[np.nan, np.nan], z[2:].mean(1)])
    curve = np.where(np.arange(n_ch + 1) < max(2, least), -np.inf, mean)
    curve = np.where(np.isnan(curve), -np.inf, curve)
    best = int(curve.argmax())
    if sensitive:
        for s in range(max(2, least), n_ch):
            if curve[s] > curve[s - 1] and curve[s] >= curve[s + 1]:
                before, after = z[s], z[s + 1]
                if welch_test(before, after)[1] < 0.05 and after.mean() < before.mean():
                    best = s
                    break
    chosen = order[:best]
    return {"order": order, "score": score, "size": best, "channels": np.sort(chosen), "curve": mean[2:], "reference": whole[chosen].sum(0) / np.where(has[chosen].any(0), has[chosen].sum(0), np.nan)}


# ---------------------------------------------------------------- CRP


def cross_projections(v: np.ndarray) -> np.ndarray:
    """Products of each trial (column) with every other, unit-scaled on one side; the diagonal is left out."""
    norm = np.linalg.norm(v, axis=0)
    unit = v / np.where(norm == 0, 1, norm)
    p = unit.T @ v
    return p[~np.eye(p.shape[0], dtype=bool)]


def kernel_pca(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions in time by the smaller Gram matrix, strongest first: (components by column, strengths)."""
    if v.shape[1] > v.shape[0]:
        w, e = np.linalg.eigh(v @ v.T)
        s = np.sqrt(np.maximum(w[::-1], 0))
        return e[:, ::-1] * (s > 1e-12 * max(1, s.max(initial=0))), s
    w, e = np.linalg.eigh(v.T @ v)
    w, e = np.maximum(w[::-1], 0), e[:, ::-1]
    s = np.sqrt(w)
    c = v @ e
    c = c / np.where(s > 1e-12 * max(1, s.max(initial=0)), s, 1)
    return c, s


def independent_pairs(n: int) -> np.ndarray:
    """Off-diagonal places such that each trial is used about evenly and no pair twice."""
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j and ((i < j) == ((i + j) % 2 == 1))]
    flat = [i * (n - 1) + (j if j < i else j - 1) for i, j in pairs]
    return np.array(sorted(flat), int)


def pair_sums(u: np.ndarray, v: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(every, free): size, sum and sum of squares of the products of trials u with other trials v, over all pairs and over the
    independent ones, by row and by column: (2, 3, trial). Rows go in blocks, so no matrix of all pairs is held."""
    n = u.shape[1]
    at = np.arange(n)
    every, free = np.zeros((2, 3, n)), np.zeros((2, 3, n))
    for a in range(0, n, block):
        i = at[a : a + block, None]
        p = u[:, a : a + block].T @ v
        off = i != at
        for out, mask in ((every, off), (free, off & ((i < at) == ((i + at) % 2 == 1)))):
            m = np.where(mask, p, 0)
            for k, x in enumerate((mask, m, m * m)):
                out[0, k, a : a + block] = x.sum(1)
                out[1, k] += x.sum(0)
    return every, free


def units(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=0)
    return v / np.where(norm == 0, 1, norm)


def mean_projection(v: np.ndarray) -> float:
    """The mean of cross_projections, without the pairs."""
    u, n = units(v), v.shape[1]
    return (u.sum(1) @ v.sum(1) - (u * v).sum()) / (n * (n - 1)) if n > 1 else math.nan


def projection_profile(v: np.ndarray, step: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(ends, mean cross projection) over growing windows."""
    ends = np.arange(max(step, 2), len(v) + 1, step)
    if not len(ends) or ends[-1] != len(v):
        ends = np.append(ends, len(v))
    return ends, np.array([mean_projection(v[:e]) for e in ends])


def crp(v: np.ndarray, time: np.ndarray, start: float = 0.015, end: float = 1.0, remove: bool = True, artifact_p: float = 1e-5, threshold: float = 0.98, step: int = 5, onset: bool = False, pairs: bool = True) -> dict:
    """Canonical response of (time, trial): duration, shape, weights, residuals, and how sure one may be of them.

    ``pairs`` adds the projections of every pair; all else comes from sums over them.
    """
    time = np.asarray(time, float)
    window = np.flatnonzero((time >= start) & (time <= end))
    ok = np.isfinite(v).all(0)
    kept = np.flatnonzero(ok)
    v = v[:, ok]

    def core(x: np.ndarray) -> dict:
        w = x[window]
        dt = float(np.median(np.diff(time))) if len(time) > 1 else 1.0
        ends, profile = projection_profile(w, step)
        scaled = profile * math.sqrt(dt)
        at = int(scaled.argmax())
        tau = int(ends[at])
        part = w[:tau]
        c = kernel_pca(part)[0][:, 0]
        if (c @ part).mean() < 0:
            c = -c
        alpha = c @ part
        residual = part - np.outer(c, alpha)
        full = kernel_pca(w)[0][:, 0]
        full = -full if (full @ w).mean() < 0 else full
        ss, rs = (part**2).sum(0), (residual**2).sum(0)
        t_at, p_at = t_of(*moments(*pair_sums(units(part), part)[1][0].sum(1)))
        t_all, p_all = t_of(*moments(*pair_sums(units(w), w)[1][0].sum(1)))
        near = np.flatnonzero(scaled >= threshold * scaled[at]) if scaled[at] > 0 else np.array([at])
        return {
            "tau": float(time[window[tau - 1]]), "tau_samples": tau, "tau_low": float(time[window[ends[near[0]] - 1]]), "tau_high": float(time[window[ends[near[-1]] - 1]]),
            "C": c, "C_full": full, "alpha": alpha, "alpha_prime": alpha / math.sqrt(tau), "residual": residual,
            "explained": 1 - rs / np.where(ss == 0, 1, ss), "snr": alpha / np.where(rs == 0, 1, np.sqrt(rs)), "profile_end": time[window[ends - 1]], "profile": scaled,
            "t_at_tau": t_at, "p_at_tau": p_at, "t_full": t_all, "p_full": p_all,
        } | ({"projections": cross_projections(part)} if pairs else {})

    out = core(v)
    if remove and v.shape[1] > 3:
        n = v.shape[1]
        part = v[window]
        every, free = pair_sums(units(part), part)
        own, rest = every.sum(0), free[0].sum(1)[:, None] - free.sum(0)
        bad = []
        for k in range(n):
            mine = moments(*own[:, k])
            t, pv = welch_of(mine, moments(*rest[:, k]))
            # a trial goes if it agrees less with the others than they with each other, and its projections are negative on average
            if pv < artifact_p and t < 0 and mine[1] <= 0:
                bad.append(k)
        if bad and n - len(bad) > 2:
            out = core(np.delete(v, bad, axis=1))
            out["artifacts"] = kept[bad]
            kept = np.delete(kept, bad)
    out.setdefault("artifacts", np.zeros(0, int))
    out["trials"] = kept
    out["params_time"] = time[window[: out["tau_samples"]]]
    if onset:
        out["onset"] = crp_onset(v[:, np.isin(np.flatnonzero(ok), kept)], time, window, out["tau_samples"], threshold, step)
    return out


def crp_onset(v: np.ndarray, time: np.ndarray, window: np.ndarray, tau: int, threshold: float, step: int) -> float:
    """From the end of the response backwards: the latest start that keeps most of the strongest projection."""
    w = v[window][:tau][::-1]
    ends, profile = projection_profile(w, step)
    top = profile.max()
    first = int(ends[np.flatnonzero(profile >= threshold * top)[0]]) if top > 0 else tau
    return float(time[window[max(0, tau - first)]])


# ---------------------------------------------------------------- clusters of shapes


def significance(p: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """mean / (sd / sqrt n) of the projections between groups of trials; within one, the diagonal is left out."""
    k = len(groups)
    out = np.zeros((k, k))
    for a, i in enumerate(groups):
        for b, j in enumerate(groups):
            s = p[np.ix_(i, j)]
            s = s[~np.eye(len(i), dtype=bool)] if a == b else s.reshape(-1)
            sd = s.std(ddof=1) if len(s) > 1 else 0
            out[a, b] = s.mean() / (sd / math.sqrt(len(s))) if sd > 0 else 0.0
    return out


def significance_by_moments(x: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """significance() of the trials (time, trial) themselves: the sum of u_i . v_j over pairs is U . V, that of squares <sum u u', sum v v'>."""
    u = units(x)
    own = (u * x).sum(0)
    s = np.stack([u[:, i].sum(1) for i in groups]) @ np.stack([x[:, i].sum(1) for i in groups]).T
    q = np.stack([(u[:, i] @ u[:, i].T).ravel() for i in groups]) @ np.stack([(x[:, i] @ x[:, i].T).ravel() for i in groups]).T
    size = np.array([len(i) for i in groups], float)
    n = np.outer(size, size) - np.diag(size)
    s -= np.diag([own[i].sum() for i in groups])
    q -= np.diag([(own[i] ** 2).sum() for i in groups])
    sd = np.sqrt(np.maximum((q - s * s / np.maximum(n, 1)) / np.maximum(n - 1, 1), 0)) * (n > 1)
    return np.where(sd > 0, s / np.maximum(n, 1) / np.where(sd > 0, sd / np.sqrt(np.maximum(n, 1)), 1), 0.0)


def winners(h: np.ndarray, null_class: bool = True) -> np.ndarray:
    """The strongest factor of each column, -1 where it is weaker than the mean expected of no class."""
    who = h.argmax(0)
    if null_class and h.shape[1]:
        scaled = h / np.maximum(h.max(1, keepdims=True), 1e-12)
        who = np.where(scaled.max(0) < 1 / (2 * math.sqrt(h.shape[1])), -1, who)
    return who


def first_shape(x: np.ndarray) -> np.ndarray:
    c = kernel_pca(x)[0][:, 0]
    return c if (c @ x).mean() >= 0 else -c


def bpc(x: np.ndarray, groups, n: int | None = None, start: int | None = None, threshold: float = 1.0, null_class: bool = True, **options) -> dict:
    """Basis profile curves of (time, trial) whose trials belong to groups."""
    groups = np.asarray(groups)
    names = sorted(set(groups.tolist()))
    idx = [np.flatnonzero(groups == g) for g in names]
    # one matrix of times a group, unless that of all pairs of trials is smaller
    xi = significance(units(x).T @ x, idx) if x.shape[1] ** 2 < 2 * len(idx) * len(x) ** 2 else significance_by_moments(x, idx)
    positive = np.maximum(xi, 0)
    positive = positive / max(positive.max(), 1e-12)
    fit, k = (nmf(positive, n, **options), n) if n else nmf_rank(positive, start or min(10, len(names)), threshold, **options)
    scale = np.linalg.norm(fit["w"], axis=0)
    who = winners(fit["h"] * scale[:, None], null_class)
    curves, rows = [], []
    for c in range(k):
        members = [g for g in range(len(names)) if who[g] == c]
        if not members:
            curves.append(np.zeros(len(x)))
            continue
        shape = first_shape(x[:, np.concatenate([idx[g] for g in members])])
        curves.append(shape)
        for g in members:
            part = x[:, idx[g]]
            alpha = shape @ part
            rest = np.linalg.norm(part - np.outer(shape, alpha), axis=0)
            t, pv = t_test(alpha)
            rows.append({"group": names[g], "curve": c, "weight": float(alpha.mean()), "snr": float((alpha / np.where(rest == 0, 1, rest)).mean()), "t": t, "p": pv})
    return {"xi": xi, "curves": np.array(curves).T, "assignment": dict(zip(names, who.tolist())), "statistics": rows, "rank": k}


def crp_cluster(results: list[dict], paired: bool = True, n: int | None = None, threshold: float = 1.0, null_class: bool = True, trials: list[np.ndarray] | None = None, **options) -> dict:
    """Contacts grouped by the shapes of their responses."""
    length = min(len(r["C_full"]) for r in results)
    shapes = np.stack([r["C_full"][:length] for r in results], 1)
    unit = shapes / np.maximum(np.linalg.norm(shapes, axis=0), 1e-12)
    if paired and trials is not None:
        blocks = [t[:length] for t in trials]
        x = np.concatenate(blocks, 1)
        at = np.cumsum([0, *(b.shape[1] for b in blocks)])
        norm = np.linalg.norm(x, axis=0)
        s = significance((x / np.where(norm == 0, 1, norm)).T @ x, [np.arange(a, b) for a, b in zip(at, at[1:])])
    else:
        s = unit.T @ unit
    s = np.maximum(s, 0)
    s = s / max(s.max(), 1e-12)
    fit, k = (nmf(s, n, **options), n) if n else nmf_rank(s, min(10, len(results)), threshold, **options)
    who = winners(fit["h"] * np.linalg.norm(fit["w"], axis=0)[:, None], null_class)
    basis = [first_shape(unit[:, who == c]) if (who == c).any() else np.zeros(length) for c in range(k)]
    fitness = [float(unit[:, i] @ basis[c]) if c >= 0 else 0.0 for i, c in enumerate(who)]
    return {"similarity": s, "assignment": who, "basis": np.array(basis).T, "rank": k, "fitness": np.array(fitness)}
