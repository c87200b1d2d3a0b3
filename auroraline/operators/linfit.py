"""Least-squares fits from one pass of moments; only matrices of terms reach the driver."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Gram matrix, cross products with the target, and sums of squares, of n rows."""

    names: list[str]
    n: float
    gram: np.ndarray
    cross: np.ndarray
    target: float

    def error(self, coef: np.ndarray) -> float:
        """Root mean square residual of a coefficient vector."""
        sse = self.target - 2 * coef @ self.cross + coef @ self.gram @ coef
        return math.sqrt(max(sse, 0.0) / self.n) if self.n else math.nan


def moments(rows: DataFrame, terms: list[tuple[str, Column]], target: Column, by: list[str] | None = None) -> dict[tuple, Moments]:
    """Moments for each group in ``by``; rows with a null term or target are left out.  Without ``by`` there is one group (), of zeros if no row is left."""
    names = [n for n, _ in terms]
    p = len(names)
    base = rows.select(*(by or []), *[e.cast("double").alias(f"_t{i}") for i, (_, e) in enumerate(terms)], target.cast("double").alias("_y"))
    base = base.dropna(subset=[*[f"_t{i}" for i in range(p)], "_y"])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs = [F.count("*").alias("_n"), F.sum(F.col("_y") * F.col("_y")).alias("_yy")]
    aggs += [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_g{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"_t{i}") * F.col("_y")).alias(f"_c{i}") for i in range(p)]
    out = {}
    for r in base.groupBy(*(by or [])).agg(*aggs).collect():  # a row per group of the model
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"_g{i}_{j}"] or 0.0
        out[tuple(r[k] for k in by or [])] = Moments(names, r["_n"], g, np.array([r[f"_c{i}"] or 0.0 for i in range(p)]), r["_yy"] or 0.0)
    return out


def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Solution with unit-norm columns first, which keeps nearly collinear terms apart as long as doubles can."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return np.linalg.lstsq(gram / np.outer(scale, scale), cross / scale, rcond=1e-12)[0] / scale


def ridge(m: Moments, penalty: float, free: tuple[int, ...] = (0,)) -> np.ndarray:
    """Ridge regression on columns of unit mean square; terms in ``free`` (the constant) are not penalised."""
    scale = np.sqrt(np.maximum(np.diag(m.gram) / max(m.n, 1), 1e-300))
    g, c = m.gram / np.outer(scale, scale), m.cross / scale
    shrink = np.full(len(c), penalty)
    shrink[list(free)] = 0.0
    return np.linalg.solve(g + np.diag(shrink) + 1e-12 * np.eye(len(c)), c) / scale


def stlsq(m: Moments, threshold: float, rounds: int = 50) -> np.ndarray:
    """Sequentially thresholded least squares on unit-norm columns, until the support stays; then a plain fit on it."""
    norm = np.sqrt(np.maximum(np.diag(m.gram), 1e-300))
    support = np.arange(len(norm))
    for _ in range(rounds):
        coef = solve(m.gram[np.ix_(support, support)], m.cross[support])
        keep = support[np.abs(coef) * norm[support] >= threshold]
        if len(keep) == len(support) or not len(keep):
            support = keep
            break
        support = keep
    out = np.zeros(len(norm))
    if len(support):
        out[support] = solve(m.gram[np.ix_(support, support)], m.cross[support])
    return out


def sweep(m: Moments, thresholds: list[float]) -> list[tuple[float, int, float]]:
    """(threshold, number of terms, RMSE) from one set of moments."""
    return [(t, int((c != 0).sum()), m.error(c)) for t in thresholds for c in [stlsq(m, t)]]


def collinearity(m: Moments) -> tuple[float, np.ndarray]:
    """Condition number of the unit-norm terms, and the variance inflation of each."""
    norm = np.sqrt(np.maximum(np.diag(m.gram), 1e-300))
    r = m.gram / np.outer(norm, norm)
    values = np.linalg.eigvalsh(r)
    return math.sqrt(max(values[-1], 0) / max(values[0], 1e-16)), np.diag(np.linalg.pinv(r))


def project_simplex(x: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """The nearest vector with sum 1 and entries of ``floor`` or more."""
    free = 1 - floor * len(x)
    y = np.sort(x - floor)[::-1]
    k = np.arange(1, len(x) + 1)
    level = (np.cumsum(y) - free) / k
    last = np.flatnonzero(y - level > 0)[-1]
    return np.maximum(x - floor - level[last], 0) + floor


def stack(m: Moments, floor: float = 0.0, rounds: int = 5000) -> np.ndarray:
    """Weights on the simplex by projected gradient with the Lipschitz step."""
    w = np.full(len(m.names), 1 / len(m.names))
    step = 1 / max(np.linalg.eigvalsh(m.gram)[-1], 1e-12)
    for _ in range(rounds):
        new = project_simplex(w - step * (m.gram @ w - m.cross), floor)
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    return w


def exact_stack(m: Moments) -> np.ndarray:
    """Weights on the simplex by enumeration of supports: for each the equality-constrained solution, if none is negative."""
    p, best, least = len(m.names), None, math.inf
    for size in range(1, p + 1):
        for s in itertools.combinations(range(p), size):
            s = list(s)
            k = np.block([[m.gram[np.ix_(s, s)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(k, np.append(m.cross[s], 1.0), rcond=None)[0][:size]
            if (w >= -1e-12).all():
                full = np.zeros(p)
                full[s] = np.maximum(w, 0)
                if (e := m.error(full)) < least - 1e-12:
                    best, least = full, e
    return best


def best_subset(m: Moments, largest: int) -> tuple[list[str], np.ndarray, float]:
    """The subset of at most ``largest`` terms with the least BIC; ties go to the smaller one."""
    best = ([], np.zeros(len(m.names)), m.n * math.log(max(m.target / max(m.n, 1), 1e-300)))
    if not m.n:
        return best
    for size in range(1, largest + 1):
        for s in itertools.combinations(range(len(m.names)), size):
            c = np.zeros(len(m.names))
            c[list(s)] = solve(m.gram[np.ix_(s, s)], m.cross[list(s)])
            bic = m.n * math.log(max(m.error(c) ** 2, 1e-300)) + size * math.log(m.n)
            if bic < best[2] - 1e-9:
                best = ([m.names[i] for i in s], c, bic)
    return best


def spectral_radius(coef: np.ndarray, lags: int) -> float:
    """Largest modulus of the companion matrix of an autoregression (equations x (states * lags))."""
    k = coef.shape[0]
    companion = np.zeros((k * lags, k * lags))
    companion[:k] = coef
    companion[k:, : k * (lags - 1)] = np.eye(k * (lags - 1))
    return float(np.abs(np.linalg.eigvals(companion)).max())
