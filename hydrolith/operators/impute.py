"""Imputation of series: numpy kernels, one group a task, and donors as a DataFrame plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rng_for(*parts: object) -> np.random.Generator:
    """A generator whose seed is a digest of the parts [V09]."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big"))


def soft_impute(x: np.ndarray, rank: int, shrink: float = 0.0, rounds: int = 80, tol: float = 1e-5, start: str | np.ndarray = "column", stop: str = "norm") -> np.ndarray:
    """Fills nan by truncated, shrunk SVDs with observed cells put back each round [I09, M05].

    Starts from the means of columns or rows, or from a matrix; stops when the relative norm of a round's change, or
    with stop='cell' its largest change of a cell, is within tol.
    """
    seen = np.isfinite(x)
    if not seen.any():
        return np.zeros_like(x)
    if isinstance(start, np.ndarray):
        fill = start
    else:
        axis = {"column": 0, "row": 1}[start]
        n = seen.sum(axis=axis, keepdims=True)
        mean = np.where(seen, x, 0).sum(axis=axis, keepdims=True) / np.maximum(n, 1)
        fill = np.broadcast_to(np.where(n > 0, mean, x[seen].mean()), x.shape)
    out = np.where(seen, x, fill)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(out, full_matrices=False)
        new = np.where(seen, x, (u[:, :rank] * np.maximum(s[:rank] - shrink, 0)) @ v[:rank])
        moved = np.abs(new - out).max() if stop == "cell" else np.linalg.norm(new - out) / max(np.linalg.norm(out), 1e-12)
        out = new
        if moved <= tol:
            break
    return out


def soft_impute_many(x: np.ndarray, rank: int, rounds: int, tol: float) -> np.ndarray:
    """soft_impute() without shrinkage, from row means to the largest change of a cell, of many matrices of one shape at once.

    The leading singular vectors of the shorter side come from its products, and only missing cells are made anew.
    """
    if x.shape[1] > x.shape[2]:
        raise ValueError("more rows than columns")
    seen = np.isfinite(x)
    n = seen.sum(axis=2, keepdims=True)
    whole = np.where(seen, x, 0).sum(axis=(1, 2)) / np.maximum(n.sum(axis=(1, 2)), 1)
    out = np.where(seen, x, np.where(n > 0, np.where(seen, x, 0).sum(axis=2, keepdims=True) / np.maximum(n, 1), whole[:, None, None]))
    left = np.flatnonzero(~seen.all(axis=(1, 2)))
    now, last = out[left], None
    for _ in range(rounds):
        if not len(left):
            break
        if last is not left:
            b, i, j = np.nonzero(~seen[left])
            first, last = np.flatnonzero(np.diff(b, prepend=-1)), left
        turned = now.transpose(0, 2, 1)
        u = np.linalg.eigh(now @ turned)[1][:, :, -rank:]
        new = np.einsum("nk,nk->n", u[b, i], (turned @ u)[b, j])
        moved = np.maximum.reduceat(np.abs(new - now[b, i, j]), first)
        now[b, i, j] = new
        if (moved <= tol).any():
            out[left] = now
            left = left[moved > tol]
            now = out[left]
    out[left] = now
    return out


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights by the normal equations [V10]."""
    return np.linalg.lstsq(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y, rcond=None)[0]


def elm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, hidden: int = 500, penalty: float = 100.0) -> Callable[[np.ndarray], np.ndarray]:
    """Extreme learning machine: random ReLU layer, ridge readout whose last two weights go unpenalised [M01]."""
    w, b = rng.normal(size=(x.shape[1], hidden)), rng.normal(size=hidden)
    h = np.maximum(x @ w + b, 0)
    d = np.eye(hidden)
    d[-2:, -2:] = 0
    out = np.linalg.lstsq(h.T @ h + penalty * d, h.T @ y, rcond=None)[0]
    return lambda z: np.maximum(z @ w + b, 0) @ out


def reservoir(inputs: np.ndarray, observed: np.ndarray, rng: np.random.Generator, size: int = 40, radius: float = 0.9, leak: float = 1.0, alpha: float = 1e-2, dt: float = 0.1) -> np.ndarray:
    """Closed-form continuous reservoir with a ridge readout learned where observed isn't nan [M06]."""
    seen = np.isfinite(observed)
    lo, hi = (observed[seen].min(), observed[seen].max()) if seen.any() else (0.0, 1.0)
    scale = (hi - lo) / 1.6 or 1.0
    y = (observed - (lo + hi) / 2) / scale
    win = rng.uniform(-1, 1, (size, inputs.shape[1]))
    wres = rng.uniform(-1, 1, (size, size)) * (rng.random((size, size)) < 0.2)
    top = np.abs(np.linalg.eigvals(wres)).max()
    wres *= radius / top if top > 0 else 0
    decay = np.exp(-leak * dt)
    state, states = np.zeros(size), np.empty((len(inputs), size))
    for i, u in enumerate(inputs):
        state = state * decay + (1 - decay) / leak * np.tanh(win @ u + wres @ state)
        states[i] = state
    design = np.hstack([np.ones((len(states), 1)), states])
    weights = ridge(design[seen], y[seen], alpha) if seen.any() else np.zeros(size + 1)
    return design @ weights * scale + (lo + hi) / 2


def euler_reservoir(inputs: np.ndarray, observed: np.ndarray, rng: np.random.Generator, size: int = 40, radius: float = 0.9, leak: float | np.ndarray = 0.3, alpha: float = 1e-2, dt: float = 0.1, both_ways: bool = False, liquid: bool = False) -> np.ndarray:
    """Reservoir by Euler steps x += dt (tanh(W u + R x) - leak x) with a ridge readout [M16].

    both_ways adds states from the end back [M17]; liquid multiplies the leak by 1 + tanh(mean of the inputs but the first) / 2 [M20].
    """
    seen = np.isfinite(observed)
    lo, hi = (observed[seen].min(), observed[seen].max()) if seen.any() else (0.0, 1.0)
    scale = (hi - lo) / 1.6 or 1.0

    def run(u: np.ndarray) -> np.ndarray:
        win = rng.uniform(-1, 1, (size, u.shape[1]))
        wres = np.where(rng.random((size, size)) < 0.2, rng.uniform(-1, 1, (size, size)), 0.0)
        top = np.abs(np.linalg.eigvals(wres)).max()
        wres *= radius / top if top > 1e-10 else radius
        x, states = np.zeros(size), np.empty((len(u), size))
        for i, v in enumerate(u):
            pace = 1 + 0.5 * np.tanh(v[1:].mean()) if liquid and len(v) > 1 else 1.0
            x = x + dt * (np.tanh(win @ v + wres @ x) - pace * leak * x)
            states[i] = x
        return states

    parts = [run(inputs)] + ([run(inputs[::-1])[::-1]] if both_ways else [])
    design = np.hstack([np.ones((len(inputs), 1)), *parts])
    y = (observed - (lo + hi) / 2) / scale
    weights = ridge(design[seen], y[seen], alpha) if seen.any() else np.zeros(design.shape[1])
    return design @ weights * scale + (lo + hi) / 2


def ensemble_reservoir(inputs: np.ndarray, observed: np.ndarray, members: int = 5, size: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of reservoirs run both ways, their leaks 0.1, 0.3 and 0.7 by thirds, their seeds 1000 i + 42 [M17]."""
    leak = np.repeat([0.1, 0.3, 0.7], -(-size // 3))[:size]
    runs = np.array([euler_reservoir(inputs, observed, np.random.default_rng(1000 * i + 42), size, leak=leak, both_ways=True) for i in range(members)])
    return runs.mean(axis=0), runs.std(axis=0)


def kge(observed: np.ndarray, predicted: np.ndarray) -> float:
    """Kling-Gupta efficiency with sample deviations: -1 without spread of observations, minus infinity if their mean is 0 [V03]."""
    if len(observed) < 2 or observed.std() == 0:
        return -1.0
    if observed.mean() == 0:
        return -np.inf
    r = np.corrcoef(observed, predicted)[0, 1] if predicted.std() > 0 else 0.0
    return float(1 - np.sqrt((r - 1) ** 2 + (predicted.std() / observed.std() - 1) ** 2 + (predicted.mean() / observed.mean() - 1) ** 2))


def search_reservoir(inputs: np.ndarray, observed: np.ndarray, rng: np.random.Generator, trials: int = 30) -> tuple[dict, np.ndarray]:
    """The best of random sizes 10-80 and leaks 0.05-0.95, and its series: KGE less 0.05 for each filled value beyond 2.5 deviations [M07]."""
    seen = np.isfinite(observed)
    best, found = (-np.inf, {}), np.full(len(observed), np.nanmean(observed))
    for _ in range(trials):
        size, leak = int(rng.integers(10, 81)), float(rng.uniform(0.05, 0.95))
        guess = euler_reservoir(inputs, observed, rng, size, leak=leak)
        z = (guess - guess.mean()) / (guess.std(ddof=1) or 1.0)
        score = kge(observed[seen], guess[seen]) - 0.05 * int((np.abs(z[~seen]) > 2.5).sum())
        if score > best[0]:
            best, found = (score, {"size": size, "leak": leak, "score": score}), guess
    return best[1], found


def gaussian_process(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at times by a process with kernel c RBF(length) + noise; the likeliest of a grid of lengths and noises [M21].

    The variance c has its likeliest value for each of them. Fewer than two known values give their mean.
    """
    if len(t) < 2 or np.ptp(y) == 0:
        return np.full(len(at), y.mean() if len(y) else 0.0), np.zeros(len(at))
    mean, sd = y.mean(), y.std()
    z, n = (y - mean) / sd, len(t)
    gap = (t[:, None] - t) ** 2
    best = (-np.inf,)
    for length in np.geomspace(1.0, max(np.ptp(t), 2.0), 12):
        k = np.exp(-gap / (2 * length * length))
        values, vectors = np.linalg.eigh(k)
        turned = (vectors.T @ z) ** 2
        for noise in np.geomspace(1e-4, 10, 12):
            spread = np.maximum(values, 0) + noise
            c = (turned / spread).sum() / n
            likely = -0.5 * (n * np.log(c) + np.log(spread).sum())
            if likely > best[0]:
                best = (likely, length, noise, c)
    _, length, noise, c = best
    k = np.exp(-gap / (2 * length * length)) + noise * np.eye(n)
    cross = np.exp(-((at[:, None] - t) ** 2) / (2 * length * length))
    solved = np.linalg.solve(k, np.column_stack([z, cross.T]))
    variance = c * np.maximum(1 + noise - (cross * solved[:, 1:].T).sum(axis=1), 0)
    return mean + sd * cross @ solved[:, 0], sd * np.sqrt(variance)


def polynomial_placeholder(t: np.ndarray, aux: np.ndarray, observed: np.ndarray, alpha: float = 1e-2) -> np.ndarray:
    """Ridge on 1, t, t^2, aux, aux t and up to ten products of pairs, five times the penalty; on 1, t, aux if values are few [M19]."""
    seen = np.isfinite(observed)
    u = (t - t.min()) / (np.ptp(t) or 1.0)
    pairs = [aux[:, i] * aux[:, j] for i in range(aux.shape[1]) for j in range(i + 1, aux.shape[1])][:10]
    x = np.column_stack([np.ones(len(u)), u, u * u, aux, aux * u[:, None], *pairs])
    if seen.sum() < x.shape[1] + 2:
        x, alpha = np.column_stack([np.ones(len(u)), u, aux]), alpha / 5
    return x @ ridge(x[seen], observed[seen], 5 * alpha)


def denoised(inputs: np.ndarray, observed: np.ndarray, rng: np.random.Generator, runs: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of runs that refit a ridge to its own result with ever less noise, from a ridge baseline [M25]."""
    seen = np.isfinite(observed)
    mean, sd = observed[seen].mean(), observed[seen].std() or 1.0
    z = (observed - mean) / sd
    baseline = inputs @ ridge(inputs[seen], z[seen], 0.1)
    out = []
    for _ in range(runs):
        x = baseline
        for level in np.geomspace(1.0, 0.05, 5):
            noisy = np.where(seen, z, x) + level * rng.normal(size=len(z)) * ~seen
            design = np.column_stack([inputs, noisy])
            x = design @ ridge(design[seen], z[seen], 0.1 + level) if seen.sum() > 2 else x
            x = (1 - level) * x + level * baseline
        out.append(x)
    runs_of = np.array(out) * sd + mean
    return runs_of.mean(axis=0), runs_of.std(axis=0)


def complete_with_donors(x: np.ndarray, target: int, month: np.ndarray, donors: int = 50, common: int = 8, rank: int = 3) -> np.ndarray:
    """Series ``target`` of x (series x months) from a matrix of itself, its best-correlated donors and the season [M04].

    Rows are z-scores, donors weighed by |r|. The rank is the least that the method admits, for errors on observed
    cells, which are put back, never tell ranks apart. The result is scaled to the spread of observations (MOVE.1) and
    kept within their range widened by a fifth, 1 at least.
    """
    y = x[target]
    seen = np.isfinite(y)
    if seen.sum() < 3:
        return np.where(seen, y, y[seen].mean() if seen.any() else 0.0)
    found = []
    for i in range(len(x)):
        both = seen & np.isfinite(x[i])
        if i != target and both.sum() >= common and x[i][both].std() > 0 and y[both].std() > 0:
            found.append((float(np.corrcoef(x[i][both], y[both])[0, 1]), i))
    found = sorted(found, key=lambda f: (-abs(f[0]), f[1]))[:donors]

    r, at = np.array([[f[0] for f in found]]), np.array([[f[1] for f in found]], int)
    return complete_from(y[None], r, at, x, month, rank)[0]


def complete_from(y: np.ndarray, r: np.ndarray, at: np.ndarray, pool: np.ndarray, month: np.ndarray, rank: int = 3) -> np.ndarray:
    """Series y (series x months) completed as by complete_with_donors(), from donors that are known: correlations r, rows ``at`` of pool (-1: none)."""

    def z(v: np.ndarray) -> np.ndarray:
        some = np.isfinite(v)
        n, filled = some.sum(axis=1, keepdims=True), np.where(some, v, 0)
        gap = np.where(some, v - filled.sum(axis=1, keepdims=True) / np.maximum(n, 1), np.nan)
        same = np.where(some, v, -np.inf).max(axis=1) == np.where(some, v, np.inf).min(axis=1)
        sd = np.sqrt(np.nansum(gap * gap, axis=1) / np.maximum(n[:, 0] - 1, 1))
        return np.where(same[:, None], gap * 0, gap / np.where(same | (sd == 0), 1.0, sd)[:, None])

    seen = np.isfinite(y)
    counts = (at >= 0).sum(axis=1)
    angle = 2 * np.pi * month / 12
    out, own, others = y.copy(), z(y), z(pool) if len(pool) else pool
    for i in np.flatnonzero(seen.sum(axis=1) < 3):
        out[i] = np.where(seen[i], y[i], y[i][seen[i]].mean() if seen[i].any() else 0.0)
    for k in np.unique(counts):
        which = np.flatnonzero((counts == k) & (seen.sum(axis=1) >= 3))
        for start in range(0, len(which), 64):
            some = which[start : start + 64]
            rows = np.empty((len(some), k + 3, y.shape[1]))
            rows[:, 0], rows[:, -2], rows[:, -1] = own[some], np.sin(angle), np.cos(angle)
            rows[:, 1 : k + 1] = others[at[some, :k]] * np.abs(r[some, :k])[:, :, None] if k else 0
            low = min(rank, *rows.shape[1:])
            if rows.shape[1] <= rows.shape[2]:
                done = soft_impute_many(rows, low, 100, 1e-7)[:, 0]
            else:
                done = np.array([soft_impute(m, low, rounds=100, tol=1e-7, start="row", stop="cell")[0] for m in rows])
            for i, pred in zip(some, done, strict=True):
                known = y[i][seen[i]]
                pred = pred * (known.std(ddof=1) or 1.0) + known.mean()
                pred = move1(pred, pred[seen[i]], known)
                margin = max(0.2 * np.ptp(known), 1.0)
                out[i] = np.where(seen[i], y[i], np.clip(pred, known.min() - margin, known.max() + margin))
    return out


def move1(pred: np.ndarray, model: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Maintenance of variance: scaled to the mean and deviation of observations if their ratio is between 0.1 and 10."""
    if len(observed) < 2:
        return pred
    sm, so = model.std(ddof=1), observed.std(ddof=1)
    ratio = so / sm if sm > 0 else 0.0
    return observed.mean() + ratio * (pred - model.mean()) if 0.1 < ratio < 10 else pred


def seasonal_features(month: np.ndarray) -> np.ndarray:
    """Time from 0 to 1, one column a calendar month, and a constant [T17]."""
    span = max(int(month.max() - month.min()), 1)
    return np.column_stack([(month - month.min()) / span, *[(month % 12 == k).astype(float) for k in range(12)], np.ones(len(month))])


def complete_matrix(monthly: DataFrame, group: str, rank: int = 8, start: str = "column", stop: str = "norm") -> DataFrame:
    """(group, key, m, value, observed): each group's months x wells matrix completed [I10, M05]. monthly: group, key, m, value.

    The matrix of one aquifer is what one task holds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="m", columns="key", values="value", aggfunc="mean").sort_index()
        wide = wide.reindex(range(int(wide.index.min()), int(wide.index.max()) + 1))
        x = wide.to_numpy(float)
        done = soft_impute(x, max(1, min(rank, *x.shape)), start=start, stop=stop)
        out = pd.DataFrame(done, index=wide.index, columns=wide.columns).stack().rename("value").reset_index()
        out.columns = ["m", "key", "value"]
        out["observed"] = np.isfinite(x).ravel()
        out[group] = pdf[group].iloc[0]
        return out[[group, "key", "m", "value", "observed"]]

    kind = dict(monthly.dtypes)
    return monthly.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, key {kind['key']}, m long, value double, observed boolean")


def _driven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inputs of a reservoir: the observed anomaly, 0 where there is none, and the features."""
    return np.column_stack([np.where(np.isfinite(y), y - np.nanmean(y), 0) / (np.nanstd(y) or 1.0), x])


def _elm(x: np.ndarray, y: np.ndarray, m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    seen = np.isfinite(y)
    mu, sd = y[seen].mean(), y[seen].std(ddof=1) or 1.0
    return elm(x[seen], (y[seen] - mu) / sd, rng, 100)(x) * sd + mu


def _residual(x: np.ndarray, y: np.ndarray, m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    seen = np.isfinite(y)
    first = euler_reservoir(_driven(x, y), y, rng)
    return first + gaussian_process(m[seen], (y - first)[seen], m)[0]


#: What fills a series: f(features, values with nan, months, generator).
METHODS: dict[str, Callable[..., np.ndarray]] = {
    "elm": _elm,
    "reservoir": lambda x, y, m, rng: reservoir(_driven(x, y), y, rng),
    "ridge": lambda x, y, m, rng: x @ ridge(x[np.isfinite(y)], y[np.isfinite(y)], 0.01),
    "euler": lambda x, y, m, rng: euler_reservoir(_driven(x, y), y, rng),
    "liquid": lambda x, y, m, rng: euler_reservoir(_driven(x, y), y, rng, liquid=True),
    "search": lambda x, y, m, rng: search_reservoir(_driven(x, y), y, rng)[1],
    "ensemble": lambda x, y, m, rng: ensemble_reservoir(_driven(x, y), y)[0],
    "polynomial": lambda x, y, m, rng: polynomial_placeholder(m, x[:, 1:-1], y),
    "process": lambda x, y, m, rng: gaussian_process(m[np.isfinite(y)], y[np.isfinite(y)], m)[0],
    "residual": _residual,
    "denoised": lambda x, y, m, rng: denoised(x, y, rng)[0],
}


def impute_series(monthly: DataFrame, method: str = "elm", seed: int = 42, least: int = 8) -> DataFrame:
    """(key, m, observed, value): every month of a series from its first to its last.

    Methods: 'elm' [M02], 'reservoir' [M06], 'ridge' [M12], 'euler' [M16], 'liquid' [M20], 'search' [M07], 'ensemble' [M17],
    'polynomial' [M19], 'process' [M21], 'residual' (a reservoir with a process on what it leaves) [M22], 'denoised' [M25].

    monthly: key, m, value. Observed months keep their value; a series with fewer than ``least`` months gets its mean.
    """
    fit = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.groupby("m")["value"].mean().sort_index()
        s = s.reindex(range(int(s.index.min()), int(s.index.max()) + 1))
        y, m = s.to_numpy(float), s.index.to_numpy(np.int64)
        seen = np.isfinite(y)
        x = seasonal_features(m)
        if seen.sum() < least:
            guess = np.full(len(y), y[seen].mean())
        else:
            guess = fit(x, y, m.astype(float), rng_for(seed, pdf["key"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "m": m, "observed": y, "value": np.where(seen, y, guess)})

    kind = dict(monthly.dtypes)["key"]
    return monthly.groupBy("key").applyInPandas(run, f"key {kind}, m long, observed double, value double")


def donor_estimates(series: DataFrame, donors: int = 50, common: int = 8) -> DataFrame:
    """(grp, key, t, value, n_donors): mean of regressions on the best-correlated series of the group, weighed by r squared [M03].

    series: grp, key, t, value. Pairs meet within their group only, by blocks of series.
    """
    from hydrolith.operators.pairs import estimates

    return estimates(series, donors, common)


def eof_modes(monthly: DataFrame, group: str, modes: int = 3) -> DataFrame:
    """(group, mode, singular, explained): the leading modes of each group's months x wells anomalies, missing at the mean [I11]."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="m", columns="key", values="value", aggfunc="mean").to_numpy(float)
        mean = np.nanmean(x, axis=0)
        s = np.linalg.svd(np.where(np.isfinite(x), x - mean, 0), compute_uv=False)
        k = min(modes, len(s))
        total = (s**2).sum() or 1.0
        return pd.DataFrame({group: pdf[group].iloc[0], "mode": np.arange(1, k + 1, dtype=np.int32), "singular": s[:k], "explained": s[:k] ** 2 / total})

    kind = dict(monthly.dtypes)[group]
    return monthly.groupBy(group).applyInPandas(run, f"{group} {kind}, mode int, singular double, explained double")


def impute_with_donors(monthly: DataFrame, group: str, donors: int = 50, common: int = 8) -> DataFrame:
    """(group, key, m, value, observed): each series of a group completed from its donors [M04]. A task holds two blocks of series and the donors of one."""

    from hydrolith.operators.pairs import completed

    return completed(monthly, group, donors, common, lambda x, keys: x, lambda x, held, r, at, pool, months, keys: complete_from(x, r, at, pool, months))


def supported(x: np.ndarray, target: int, month: np.ndarray, rng: np.random.Generator, rounds: int = 3, share: float = 0.12) -> np.ndarray:
    """Series ``target`` completed in rounds: 12 % of its observations, 6 to 24, are hidden, and a blend of the old
    result (0.35) and the new (0.65) is taken as support only if it does better on them [M10]."""
    hidden = hidden_months(x[target], rng, share)
    held = x.copy()
    held[target, hidden] = np.nan
    first = complete_with_donors(held, target, month)
    return improved(x[target], hidden, first, month, rng, rounds) if len(hidden) else first


def hidden_months(y: np.ndarray, rng: np.random.Generator, share: float = 0.12) -> np.ndarray:
    """Places of the observations that are hidden; none of a series of fewer than 20."""
    seen = np.flatnonzero(np.isfinite(y))
    return rng.choice(seen, int(np.clip(round(share * len(seen)), 6, 24)), replace=False) if len(seen) >= 20 else seen[:0]


def improved(y: np.ndarray, hidden: np.ndarray, best: np.ndarray, month: np.ndarray, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """The rounds of supported() from a first result."""
    held = y.copy()
    held[hidden] = np.nan
    score = (kge(y[hidden], best[hidden]), -float(np.sqrt(np.mean((best[hidden] - y[hidden]) ** 2))))
    for _ in range(rounds):
        features = np.column_stack([best, seasonal_features(month)])
        new = 0.35 * best + 0.65 * euler_reservoir(_driven(features, held), held, rng)
        new_score = (kge(y[hidden], new[hidden]), -float(np.sqrt(np.mean((new[hidden] - y[hidden]) ** 2))))
        if new_score <= score:
            break
        best, score = new, new_score
    return np.where(np.isfinite(y), y, best)


def impute_supported(monthly: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """(group, key, m, value, observed) by the support loop [M10, M11]."""

    from hydrolith.operators.pairs import completed

    def hide(x: np.ndarray, keys: list) -> np.ndarray:
        held = x.copy()
        for i, key in enumerate(keys):
            held[i, hidden_months(x[i], rng_for(seed, key))] = np.nan
        return held

    def fill(x: np.ndarray, held: np.ndarray, r: np.ndarray, at: np.ndarray, pool: np.ndarray, months: np.ndarray, keys: list) -> np.ndarray:
        out = complete_from(held, r, at, pool, months)
        for i, key in enumerate(keys):
            rng = rng_for(seed, key)
            hidden = hidden_months(x[i], rng)
            if len(hidden):
                out[i] = improved(x[i], hidden, out[i], months, rng)
        return out

    return completed(monthly, group, 50, 8, hide, fill)


def holdout_benchmark(monthly: DataFrame, methods: list[str], share: float = 0.2, seed: int = 7) -> DataFrame:
    """(method, key, obs, pred) of months held out, by each method [V08]. monthly: key, m, value."""
    from hydrolith.operators.metrics import random_holdout

    split = random_holdout(monthly.select("key", "m", "value"), ["key"], "m", share, seed)
    held = split.where("held_out").select("key", "m", F.col("value").alias("obs"))
    out = None
    for method in methods:
        found = impute_series(split.where("not held_out").drop("held_out"), method).join(held, ["key", "m"])
        part = found.select(F.lit(method).alias("method"), "key", "obs", F.col("value").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def surfaces(monthly: DataFrame, wells: DataFrame, cells: DataFrame, group: str, method: str = "matrix", modes: int = 3) -> DataFrame:
    """(group, cell_id, m, value): a surface for each month from the completed series of a group's wells.

    'matrix' spreads them by inverse distances [I10]; 'grid' completes months x cells from wells at their nearest
    cells, begun with inverse distances [I14]; 'transfer' maps the spread series through each near well's regression
    on its own neighbours [I15]; 'modes' adds a ridge surface of second degree of the means, their rests and the
    loadings of the leading modes [I12]. monthly: group, key, m, value; wells: group, well_id, w_lat, w_lng; cells:
    group, cell_id, lat, lng. What a task holds is a group's months x cells.
    """
    from hydrolith.operators.spatial import idw_matrix

    def matrix(x, lat, lng, clat, clng):
        return x @ idw_matrix(lat, lng, clat, clng).T

    def grid(x, lat, lng, clat, clng):
        d = (lat[:, None] - clat) ** 2 + ((lng[:, None] - clng) * np.cos(np.radians(lat[:, None]))) ** 2
        at = d.argmin(axis=1)
        known = np.full((len(x), len(clat)), np.nan)
        for cell in np.unique(at):
            known[:, cell] = x[:, at == cell].mean(axis=1)
        return soft_impute(known, max(1, min(8, *known.shape)), rounds=100, start=matrix(x, lat, lng, clat, clng))

    def transfer(x, lat, lng, clat, clng):
        n = len(lat)
        base = matrix(x, lat, lng, clat, clng)
        if n < 3:
            return base
        slope, level = np.ones(n), np.zeros(n)
        for i in range(n):
            others = np.arange(n) != i
            p = x[:, others] @ idw_matrix(lat[others], lng[others], lat[i : i + 1], lng[i : i + 1])[0]
            spread = ((p - p.mean()) ** 2).sum()
            if spread >= 1e-10:
                slope[i] = ((p - p.mean()) * (x[:, i] - x[:, i].mean())).sum() / spread
                level[i] = x[:, i].mean() - slope[i] * p.mean()
        w = idw_matrix(lat, lng, clat, clng)
        return np.where(np.isclose(w.max(axis=1), 1), base, base * (w @ slope) + w @ level)

    def eof(x, lat, lng, clat, clng):
        mean = x.mean(axis=0)
        u, s, v = np.linalg.svd(x - mean, full_matrices=False)
        k = min(modes, len(s))
        centre, scale = np.array([lat.mean(), lng.mean()]), np.maximum([lat.std(), lng.std()], 1e-10)

        def design(a, b):
            p, q = (a - centre[0]) / scale[0], (b - centre[1]) / scale[1]
            return np.column_stack([np.ones(len(a)), p, q, p * p, q * q, p * q])

        weights = ridge(design(lat, lng), mean, 1.0)
        w = idw_matrix(lat, lng, clat, clng)
        trend = design(clat, clng) @ weights + w @ (mean - design(lat, lng) @ weights)
        return trend + (u[:, :k] * s[:k]) @ (v[:k] @ w.T)

    kernel = {"matrix": matrix, "grid": grid, "transfer": transfer, "modes": eof}[method]
    kind = dict(cells.dtypes)[group]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({group: [], "cell_id": [], "m": [], "value": []})
        wide = left.pivot_table(index="m", columns="key", values="value", aggfunc="mean").sort_index()
        place = left.groupby("key")[["w_lat", "w_lng"]].first().loc[wide.columns].to_numpy(float)
        x = wide.to_numpy(float)
        out = kernel(x, place[:, 0], place[:, 1], right["lat"].to_numpy(float), right["lng"].to_numpy(float))
        return pd.DataFrame({group: key[0], "cell_id": np.tile(right["cell_id"].to_numpy(), len(x)), "m": np.repeat(wide.index.to_numpy(np.int64), len(right)), "value": out.ravel()})

    done = complete_matrix(monthly, group)
    placed = done.join(wells.select(group, F.col("well_id").alias("key"), "w_lat", "w_lng"), [group, "key"]).select(group, "key", "m", "value", "w_lat", "w_lng")
    return placed.groupBy(group).cogroup(cells.select(group, "cell_id", "lat", "lng").groupBy(group)).applyInPandas(run, f"{group} {kind}, cell_id int, m long, value double")


def auxiliary_weights(series: DataFrame, auxiliaries: DataFrame, least: float = 0.15) -> DataFrame:
    """(key, aux, r, weight): r squared of each auxiliary with a series, 0 below ``least`` unless none reaches it and it is the best; the highest becomes 1 [M13].

    series: key, m, value; auxiliaries: key, m, aux, x.
    """
    r = F.coalesce(F.nanvl(F.corr("value", "x"), F.lit(0.0)), F.lit(0.0))
    found = series.join(auxiliaries, ["key", "m"]).groupBy("key", "aux").agg(r.alias("r"))
    own = Window.partitionBy("key")
    square = F.col("r") * F.col("r")
    rank = F.row_number().over(own.orderBy(F.abs("r").desc(), "aux"))
    kept = found.withColumn("__any", F.max(F.abs("r")).over(own) >= least).withColumn("__rank", rank)
    kept = kept.withColumn("weight", F.when((F.abs("r") >= least) | (~F.col("__any") & (F.col("__rank") == 1)), square).otherwise(0.0))
    top = F.max("weight").over(own)
    return kept.select("key", "aux", "r", F.when(top > 0, F.col("weight") / top).otherwise(0.0).alias("weight"))


def neighbour_means(series: DataFrame, near: DataFrame) -> DataFrame:
    """(key, m, value): of each series' neighbours the mean by 1 / (1 + kilometres); one without a value counts as 0 [M23].

    series: key, m, value; near: id, site_id, distance in metres, as k_nearest() gives them.
    """
    weight = 1 / (1 + F.col("distance") / 1000)
    graph = near.select(F.col("id").alias("key"), F.col("site_id").alias("__site"), weight.alias("w"))
    total = graph.groupBy("key").agg(F.sum("w").alias("total"))
    values = series.select(F.col("key").alias("__site"), "m", F.col("value").alias("v"))
    sums = graph.join(values, "__site").groupBy("key", "m").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    return sums.join(total, "key").select("key", "m", (F.col("s") / F.col("total")).alias("value"))


def small_gaps(x: np.ndarray, longest: int = 24, pad: int = 6) -> np.ndarray:
    """x (series x months) with its gaps filled as by series.fill_small_gaps()."""
    out, (row, m) = x.copy(), np.nonzero(np.isfinite(x))
    count = np.bincount(row, minlength=len(x))
    if not (count >= 3).any():
        return out
    enough = count[row] >= 3
    row, m = row[enough], m[enough]
    y, n = x[row, m], len(row)
    begins, ends = np.diff(row, prepend=-1) != 0, np.diff(row, append=len(x)) != 0

    def shifted(v: np.ndarray, by: int) -> np.ndarray:
        return v[np.clip(np.arange(n) + by, 0, n - 1)]

    with np.errstate(all="ignore"):
        h = (shifted(m, 1) - m).astype(float)
        d = (shifted(y, 1) - y) / h
        hb, db = shifted(h, -1), shifted(d, -1)

        def end(h0: np.ndarray, h1: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return np.where(np.sign(s) != np.sign(d0), 0.0, np.where((np.sign(d0) != np.sign(d1)) & (np.abs(s) > 3 * np.abs(d0)), 3 * d0, s))

        w1, w2 = 2 * h + hb, h + 2 * hb
        slope = np.where(db * d <= 0, 0.0, (w1 + w2) / (w1 / db + w2 / d))
        slope = np.where(begins, end(h, shifted(h, 1), d, shifted(d, 1)), np.where(ends, end(hb, shifted(h, -2), db, shifted(d, -2)), slope))
        gap = np.where(ends, 0, shifted(m, 1) - m - 1)
        k = np.repeat(np.arange(n), gap)
        step = np.arange(len(k)) - np.repeat(np.cumsum(gap) - gap, gap) + 1
        near = (gap[k] <= longest) | (step <= pad) | (step >= gap[k] + 1 - pad)
        k, step = k[near], step[near]
        u = step / h[k]
        u2, u3 = u * u, u * u * u
        value = (2 * u3 - 3 * u2 + 1) * y[k] + (u3 - 2 * u2 + u) * h[k] * slope[k] + (-2 * u3 + 3 * u2) * y[k + 1] + (u3 - u2) * h[k] * slope[k + 1]
    out[row[k], m[k] + step] = value
    return out


def full_series(monthly: DataFrame, group: str, longest: int = 24, pad: int = 6) -> DataFrame:
    """(group, key, m, observed, value, fill_stage) of every month of a group: small gaps by cubics, the rest from donors [M08, M11, K12, T19].

    What cubics filled supports the donors' matrix as if it were observed. A task fills the gaps of the blocks that it
    holds, so measurements are read and moved once.
    """
    from hydrolith.operators.pairs import completed
    from hydrolith.operators.series import combined

    both = completed(monthly, group, 50, 8, lambda x, keys: x, lambda x, held, r, at, pool, months, keys: complete_from(x, r, at, pool, months), lambda x: small_gaps(x, longest, pad))
    value, observed = F.col("value"), F.when(F.col("observed"), F.col("value"))
    value, stage = combined(observed, F.when(F.col("small"), value), value)
    return both.select(group, "key", "m", observed.alias("observed"), value.alias("value"), stage.alias("fill_stage"))
