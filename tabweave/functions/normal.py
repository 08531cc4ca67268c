"""Normal distribution and tabulated distributions, vectorised over numpy arrays."""

from __future__ import annotations

import math

import numpy as np

_END, _N = 8.5, 20_001
_TABLES: dict[str, np.ndarray] = {}


def pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _table() -> tuple[np.ndarray, np.ndarray]:
    if "x" not in _TABLES:
        _TABLES["x"] = np.linspace(-_END, _END, _N)
        _TABLES["p"] = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in _TABLES["x"]])
    return _TABLES["x"], _TABLES["p"]


def cdf(x: np.ndarray) -> np.ndarray:
    """Distribution function: cubic Hermite interpolation of a fine table, whose slopes are the density."""
    grid, p = _table()
    x = np.clip(np.asarray(x, float), -_END, _END)
    h = grid[1] - grid[0]
    i = np.minimum(((x + _END) / h).astype(int), _N - 2)
    t = (x - grid[i]) / h
    a, b, da, db = p[i], p[i + 1], pdf(grid[i]) * h, pdf(grid[i + 1]) * h
    return a + t * (da + t * (3 * (b - a) - 2 * da - db + t * (2 * (a - b) + da + db)))


def ppf(p: np.ndarray) -> np.ndarray:
    """Quantile function: the table read backwards, then Newton steps."""
    grid, table = _table()
    p = np.clip(np.asarray(p, float), 1e-15, 1 - 1e-15)
    x = np.interp(p, table, grid)
    for _ in range(3):
        x = np.clip(x - (cdf(x) - p) / np.maximum(pdf(x), 1e-300), -_END, _END)
    return x


def tabulated(kind: str, mean: float, std: float, lo: float, hi: float, points: int = 4097) -> tuple[list[float], list[float]]:
    """Grid and distribution function of a marginal fitted by moments: norm, uniform, truncnorm, gamma or beta.

    The density is integrated over the grid, so no special functions are needed.
    """
    std = max(std, 1e-9 * max(1.0, abs(mean)))
    if kind == "uniform" or hi <= lo:
        return [lo, max(hi, lo + 1e-9)], [0.0, 1.0]
    a, b = (mean - 8 * std, mean + 8 * std) if kind == "norm" else (lo, hi + 4 * std) if kind == "gamma" else (lo, hi)
    x = np.linspace(a, b, points)
    mid = (x[1:] + x[:-1]) / 2
    if kind in ("norm", "truncnorm"):
        log = -0.5 * ((mid - mean) / std) ** 2
    elif kind == "gamma":
        m = max(mean - lo, 1e-12)
        k, theta = (m / std) ** 2, std * std / m
        log = (k - 1) * np.log(mid - lo) - (mid - lo) / theta
    elif kind == "beta":
        m, v = (mean - lo) / (hi - lo), (std / (hi - lo)) ** 2
        s = max(m * (1 - m) / v - 1, 1e-3)
        z = (mid - lo) / (hi - lo)
        log = (m * s - 1) * np.log(z) + ((1 - m) * s - 1) * np.log1p(-z)
    else:
        raise ValueError(f"unknown marginal {kind}")
    mass = np.exp(log - log.max())
    p = np.append(0, np.cumsum(mass))
    return x.tolist(), (p / p[-1]).tolist()


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the finite sums for whole degrees."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q): the studentised range with infinite degrees, by quadrature."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 4001)
    inner = k * pdf(z) * (cdf(z) - cdf(z - q)) ** (k - 1)
    return float(min(1.0, max(0.0, 1.0 - np.trapezoid(inner, z))))
