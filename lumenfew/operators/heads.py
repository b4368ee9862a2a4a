"""Small regression heads for one cell (K support rows, p features), and how Spark runs them.

A head has ``fit(x, y)``, ``predict(x)`` and ``quantiles(x, levels)``. ``register`` adds
one, so that a tabular foundation model can be plugged in where its weights are at hand.
Fits see a cell's support only, which is small; ``experiments`` spreads them over the
cluster and applies what they found to whole tables, batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

QUANTILES = (0.025, 0.05, 0.1, 0.16, 0.25, 0.5, 0.75, 0.84, 0.9, 0.95, 0.975)
LOO_GRID = np.logspace(-4, 1, 26)
RIDGE_GRID = np.logspace(-3, 3, 13)


class Head(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> Head: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...

    def quantiles(self, x: np.ndarray, levels: tuple[float, ...]) -> np.ndarray: ...


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def ridge_fit(phi: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, the map from targets to weights, and leverages; the first column (the intercept) goes unpenalised."""
    d = np.full(phi.shape[1], penalty)
    d[0] = 0.0
    maps = np.linalg.lstsq(phi.T @ phi + np.diag(d), phi.T, rcond=None)[0]
    return maps @ y, maps, np.einsum("ij,ji->i", phi, maps)


def loo_residuals(phi: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, the target map, and leave-one-out residuals in closed form."""
    w, maps, leverage = ridge_fit(phi, y, penalty)
    return w, maps, (y - phi @ w) / np.maximum(1 - leverage, 1e-8)


def best_penalty(phi: np.ndarray, y: np.ndarray, grid: np.ndarray = LOO_GRID) -> float:
    """The penalty of the least mean squared leave-one-out residual; the first of equal ones."""
    errors = [float(np.mean(loo_residuals(phi, y, g)[2] ** 2)) for g in grid]
    return float(grid[int(np.argmin(errors))])


def inverted_cdf(values: np.ndarray, share: float) -> np.ndarray:
    """Row-wise: the least value whose empirical distribution reaches ``share``."""
    n = values.shape[1]
    return np.sort(values, axis=1)[:, min(max(math.ceil(share * n - 1e-9), 1), n) - 1]


def jackknife_plus(phi: np.ndarray, y: np.ndarray, queries: np.ndarray, level: float, penalty: float, signed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Interval ends from leave-one-out fits: the 1 - ``level`` and ``level`` points of what they predict, less and plus residuals.

    ``signed`` uses residuals with their sign; else their size, as published.
    """
    w, maps, residual = loo_residuals(phi, y, penalty)
    # the fit without row i predicts the full fit less what that row's residual had moved
    without = (queries @ w)[:, None] - (queries @ maps) * residual
    around = residual if signed else np.abs(residual)
    alpha = 1 - level
    return inverted_cdf(without - around, alpha), inverted_cdf(without + around, 1 - alpha)


class Ridge:
    """Ridge with its penalty from leave-one-out errors; quantiles from the jackknife+ distribution."""

    def __init__(self, grid: np.ndarray = LOO_GRID):
        self.grid = grid

    def fit(self, x, y):
        self.phi, self.y = with_one(x), y
        self.penalty = best_penalty(self.phi, y, self.grid)
        self.weights, self.maps, self.residual = loo_residuals(self.phi, y, self.penalty)
        return self

    def predict(self, x):
        return with_one(x) @ self.weights

    def quantiles(self, x, levels=QUANTILES):
        q = with_one(x)
        spread = (q @ self.weights)[:, None] - (q @ self.maps) * self.residual + self.residual
        return np.stack([np.quantile(spread, p, axis=1) for p in levels])


class PLS:
    """Partial least squares for one target (NIPALS with centring and scaling)."""

    def __init__(self, components: int | None = None, most: int = 15, folds: int | None = None):
        self.components, self.most, self.folds = components, most, folds

    def fit(self, x, y):
        n = self.components or best_components(x, y, self.most, self.folds)
        self.components = n
        self.mean, self.scale = x.mean(0), x.std(0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
        self.scale = np.where(self.scale > 0, self.scale, 1.0)
        self.y_mean, self.y_scale = y.mean(), (y.std(ddof=1) if len(y) > 1 else 1.0) or 1.0
        a, b = (x - self.mean) / self.scale, (y - self.y_mean) / self.y_scale
        ws, ps, qs = [], [], []
        for _ in range(min(n, a.shape[1], max(len(x) - 1, 1))):
            w = a.T @ b
            length = np.linalg.norm(w)
            if length < 1e-12:
                break
            w /= length
            t = a @ w
            tt = t @ t
            p, q = a.T @ t / tt, b @ t / tt
            a, b = a - np.outer(t, p), b - q * t
            ws.append(w), ps.append(p), qs.append(q)
        if ws:
            w, p = np.array(ws).T, np.array(ps).T
            self.rotation = w @ np.linalg.pinv(p.T @ w)
            self.q = np.array(qs)
        else:
            self.rotation, self.q = np.zeros((x.shape[1], 1)), np.zeros(1)
        return self

    def transform(self, x):
        return (x - self.mean) / self.scale @ self.rotation

    def predict(self, x):
        return self.transform(x) @ self.q * self.y_scale + self.y_mean

    def quantiles(self, x, levels=QUANTILES):
        return np.repeat(self.predict(x)[None], len(levels), 0)


def folds_of(n: int, folds: int | None = None) -> list[np.ndarray]:
    """Test rows of each fold: given unshuffled folds; else one row each up to 40 rows, five shuffled folds (seed 0) beyond."""
    if folds:
        return np.array_split(np.arange(n), min(folds, n))
    if n <= 40:
        return [np.array([i]) for i in range(n)]
    return np.array_split(np.random.RandomState(0).permutation(n), 5)


def best_components(x: np.ndarray, y: np.ndarray, most: int = 15, folds: int | None = None) -> int:
    """Components of the least cross-validated error; the fewest of equal ones."""
    parts = folds_of(len(y), folds)
    least = min(len(y) - len(p) for p in parts)
    errors = []
    for n in range(1, max(min(most, x.shape[1], least - 1), 1) + 1):
        wrong = 0.0
        for p in parts:
            rest = np.setdiff1d(np.arange(len(y)), p)
            wrong += float(((PLS(n).fit(x[rest], y[rest]).predict(x[p]) - y[p]) ** 2).sum())
        errors.append(math.sqrt(wrong / len(y)))
    return int(np.argmin(errors)) + 1


def cars(x: np.ndarray, y: np.ndarray, most: int = 15, runs: int = 50, seed: int = 0) -> np.ndarray:
    """Competitive adaptive reweighted sampling: a mask of channels (all where fewer than two would stay).

    Each run fits PLS to nine tenths of the rows, draws the channels that stay by their
    coefficients' sizes, without replacement and ever fewer, and scores them by
    cross-validation (one row out up to 40 rows, five folds beyond).
    """
    n, p = x.shape
    every = np.ones(p, bool)
    if n < 4 or runs < 2:
        return every
    rng = np.random.default_rng(seed)
    components = max(1, min(best_components(x, y, most), n - 1))
    shares = np.exp(-math.log(max(p / 2, 1.0)) / (runs - 1) * np.arange(runs))
    alive, best, least = np.arange(p), every, math.inf
    for share in shares:
        rows = rng.choice(n, max(round(0.9 * n), 3), replace=False)
        model = PLS(max(1, min(components, len(rows) - 1, len(alive)))).fit(x[rows][:, alive], y[rows])
        keep = max(2, round(share * p))
        if len(alive) > keep:
            weight = np.abs(model.rotation @ model.q / model.scale)
            able = np.count_nonzero(weight) >= keep
            alive = np.sort(rng.choice(alive, keep, replace=False, p=weight / weight.sum() if able else None))
        if len(alive) < 2:
            continue
        wrong = 0.0
        for part in folds_of(n):
            rest = np.setdiff1d(np.arange(n), part)
            held = PLS(max(1, min(components, n - 1, len(alive)))).fit(x[rest][:, alive], y[rest]).predict(x[part][:, alive])
            wrong += float(((held - y[part]) ** 2).sum())
        if wrong < least:
            least, best = wrong, np.isin(np.arange(p), alive)
    return best if best.sum() >= 2 else every


def nnls(a: np.ndarray, b: np.ndarray, most: int = 300) -> np.ndarray:
    """Non-negative least squares by an active set."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        if passive.all() or gradient.max() <= 1e-10:
            break
        passive[int(np.argmax(gradient))] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z[passive] > 0).all():
                break
            down = passive & (z <= 0)
            step = np.min(x[down] / np.maximum(x[down] - z[down], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
        x = z
    return x


class NearestMean:
    """Classes by the nearest mean of the support rows."""

    def fit(self, x, y):
        self.names = np.unique(y)
        self.means = np.stack([x[y == n].mean(0) for n in self.names])
        return self

    def predict(self, x):
        # a class at a time: no rows x classes x channels
        return self.names[np.stack([((x - m) ** 2).sum(1) for m in self.means], axis=1).argmin(1)]

    def quantiles(self, x, levels=QUANTILES):
        return np.repeat(self.predict(x)[None], len(levels), 0)


HEADS: dict[str, Callable[[], Head]] = {"ridge": Ridge, "ridge-cv": lambda: Ridge(RIDGE_GRID), "pls": PLS, "nearest-mean": NearestMean}


def register(name: str, make: Callable[[], Head]) -> None:
    HEADS[name] = make


def head(name: str) -> Head:
    if name not in HEADS:
        raise FileNotFoundError(f"no head is called {name}: register one that loads its weights (have {', '.join(HEADS)})")
    return HEADS[name]()


def scaled(support: np.ndarray, query: np.ndarray, clip: float | None = 5.0, shift: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Both sides by the support's channel means and population deviations."""
    m, s = (support.mean(0) if shift else 0.0), support.std(0) + 1e-8
    out = (support - m) / s, (query - m) / s
    return out if clip is None else (np.clip(out[0], -clip, clip), np.clip(out[1], -clip, clip))


def measures(pred: np.ndarray, y: np.ndarray) -> dict[str, float | None]:
    error = float(np.mean((pred - y) ** 2))
    spread = float(((y - y.mean()) ** 2).sum())
    root = math.sqrt(error)
    return {"r2": None if spread <= 1e-12 else 1 - error * len(y) / spread, "rmse": root, "rpd": math.inf if root <= 1e-12 else float(y.std(ddof=1)) / root if len(y) > 1 else None}


@dataclass
class Fitted:
    """A head with what its inputs go through: chosen channels, scaling, a projection; and the target's centre and scale."""

    head: Head
    centre: np.ndarray | float
    spread: np.ndarray | float
    clip: float | None = 5.0
    mask: np.ndarray | None = None
    project: Callable[[np.ndarray], np.ndarray] | None = None
    y_centre: float = 0.0
    y_spread: float = 1.0
    n_features: int = 0
    note: int = 0  #: what else there is to say of the fit, such as its components

    def inputs(self, x: np.ndarray) -> np.ndarray:
        x = x if self.mask is None else x[:, self.mask]
        z = (x - self.centre) / self.spread
        z = z if self.clip is None else np.clip(z, -self.clip, self.clip)
        return z if self.project is None else self.project(z)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.head.predict(self.inputs(x)) * self.y_spread + self.y_centre

    def quantiles(self, x: np.ndarray, levels: tuple[float, ...] = QUANTILES) -> np.ndarray:
        return self.head.quantiles(self.inputs(x), levels) * self.y_spread + self.y_centre


def fitted(made: Head, x: np.ndarray, y: np.ndarray, clip: float | None = 5.0, shift: bool = True, mask: np.ndarray | None = None, scale_y: bool = True) -> Fitted:
    """A head fitted to a support set, scaled by the support's channel means and population deviations."""
    own = x if mask is None else x[:, mask]
    out = Fitted(made, own.mean(0) if shift else 0.0, own.std(0) + 1e-8, clip, mask, n_features=own.shape[1])
    if scale_y:
        out.y_centre, out.y_spread = float(y.mean()), float(y.std()) + 1e-8
    made.fit(out.inputs(x), (y - out.y_centre) / out.y_spread if scale_y else y)
    return out


def cells(rows: DataFrame, by: list[str], fn: Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """Run ``fn(keys, x_support, y_support, x_query, y_query, query_rows)`` on each cell.

    ``rows`` has the keys, ``role``, ``idx``, ``x`` (array) and ``y``; both roles must be capped
    beforehand, for a cell is one task's. Cells without query rows give nothing.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        s, q = frame[frame.role == "support"], frame[frame.role == "query"]
        if not len(s) or not len(q):
            return pd.DataFrame({n: [] for n in names})
        stack = lambda d: np.stack(d.x.to_list()).astype(float)
        made = fn(dict(zip(by, keys, strict=True)), stack(s), s.y.to_numpy(float), stack(q), q.y.to_numpy(float), q)
        return pd.DataFrame(made, columns=names)

    return rows.groupBy(*by).applyInPandas(run, schema)


def types(rows: DataFrame, by: list[str]) -> str:
    """The schema of some columns."""
    kinds = dict(rows.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in by)
