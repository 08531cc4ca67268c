"""Dirichlet-process mixtures of normals over weighted points, by variational inference."""

from __future__ import annotations

import numpy as np

from .special import digamma, lgamma

#: Strength of the stick-breaking prior, and of the priors of mean and precision (fixed values, as is usual for this encoder).
CONCENTRATION, BETA0, DEGREES0 = 1e-3, 1.0, 1.0


class _Posterior:
    """q(v_k) = Beta(a, b) of the sticks; q(mean, precision) = Normal(m, 1 / (beta precision)) Gamma(shape, rate), all arrays over components."""

    def __init__(self, r: np.ndarray, x: np.ndarray, v: np.ndarray, m0: float, rate0: float):
        """``r``: weighted responsibilities of points with mean ``x`` and variance ``v`` within."""
        n = r.sum(0)
        order = np.argsort(-n, kind="stable")  # sticks are broken from the largest part on
        r, n = r[:, order], n[order]
        safe = np.maximum(n, 1e-300)
        mean = (r * x[:, None]).sum(0) / safe
        spread = (r * ((x[:, None] - mean) ** 2 + v[:, None])).sum(0)
        self.m0, self.rate0, self.n = m0, rate0, n
        self.a, self.b = 1 + n, CONCENTRATION + np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0]])
        self.beta = BETA0 + n
        self.m = (BETA0 * m0 + n * mean) / self.beta
        self.shape = (DEGREES0 + n) / 2
        self.rate = rate0 + 0.5 * (spread + BETA0 * n / self.beta * (mean - m0) ** 2)

    def log_shares(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Expected log of (stick share times density), a row a point."""
        both = digamma(self.a + self.b)
        rest = np.concatenate([[0], np.cumsum(digamma(self.b) - both)[:-1]])
        stick = digamma(self.a) - both + rest
        precision = self.shape / self.rate
        square = precision * ((x[:, None] - self.m) ** 2 + v[:, None]) + 1 / self.beta
        return stick + 0.5 * (digamma(self.shape) - np.log(self.rate) - np.log(2 * np.pi) - square)

    def divergence(self) -> float:
        """How far the posterior of the parameters is from their prior."""
        a, b, g = self.a, self.b, CONCENTRATION
        log_beta = lambda p, q: lgamma(p) + lgamma(q) - lgamma(p + q)
        sticks = log_beta(1.0, g) - log_beta(a, b) + (a - 1) * digamma(a) + (b - g) * digamma(b) + (1 - a + g - b) * digamma(a + b)
        s0 = DEGREES0 / 2
        gamma = (self.shape - s0) * digamma(self.shape) - lgamma(self.shape) + lgamma(s0) + s0 * (np.log(self.rate) - np.log(self.rate0)) + self.shape * (self.rate0 - self.rate) / self.rate
        normal = 0.5 * (np.log(self.beta / BETA0) + BETA0 / self.beta - 1 + BETA0 * self.shape / self.rate * (self.m - self.m0) ** 2)
        return float((sticks + gamma + normal).sum())

    def weights(self) -> np.ndarray:
        stick = self.a / (self.a + self.b)
        w = stick * np.concatenate([[1], np.cumprod(1 - stick)[:-1]])
        return w / w.sum()


def dirichlet_mixture(x: np.ndarray, n: np.ndarray, v: np.ndarray | None = None, components: int = 10, least: float = 0.005, steps: int = 300, tolerance: float = 1e-7) -> tuple[list[list[float]], list[float]]:
    """((means, deviations, weights) of the components heavier than ``least``, the lower bounds step by step).

    Points stand for ``n`` rows with mean ``x`` and variance ``v`` each.  The mixture has
    ``components`` sticks at most; those without rows keep next to no weight.  The bound is
    that of the evidence, a row; it never falls.  It starts from equal parts by rank, and
    neighbours merge where that raises the bound.
    """
    x, n = np.asarray(x, float), np.asarray(n, float)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    v = np.zeros(len(x)) if v is None else np.asarray(v, float)[order]
    total = n.sum()
    # priors and bounds in units of the column: results do not depend on its scale
    shift = (n * x).sum() / total
    unit = np.sqrt((n * ((x - shift) ** 2 + v)).sum() / total) or 1.0
    x, v = (x - shift) / unit, v / unit**2
    k = max(1, min(components, len(x)))
    part = np.minimum(((np.cumsum(n) - n / 2) / total * k).astype(int), k - 1)
    r, bounds = np.zeros((len(x), k)), []
    r[np.arange(len(x)), part] = n
    def climbed(r: np.ndarray, most: int) -> tuple[_Posterior, np.ndarray, list[float]]:
        """Coordinate ascent: parameters from responsibilities, and these from the parameters."""
        own: list[float] = []
        for _ in range(most):
            q = _Posterior(r, x, v, 0.0, 0.5)
            log = q.log_shares(x, v)
            top = log.max(1)
            e = np.exp(log - top[:, None])
            both = e.sum(1)
            own.append(float(((n * (top + np.log(both))).sum() - q.divergence()) / total))
            r = e * (n / both)[:, None]
            if len(own) > 1 and own[-1] - own[-2] < tolerance:
                break
        return q, r, own

    q, r, bounds = climbed(r, steps)
    # ascent alone leaves twins: neighbours are put together as long as the bound gains by it
    while True:
        by = np.argsort(q.m, kind="stable")
        by = by[q.n[by] > 1e-6 * total]
        tried = []
        for i, j in zip(by[:-1], by[1:]):
            one = np.delete(r, j, axis=1)
            one[:, i - (j < i)] += r[:, j]
            tried.append(climbed(one, 8))
        best = max(tried, key=lambda t: t[2][-1], default=None)
        if best is None or best[2][-1] <= bounds[-1] + tolerance:
            break
        q, r, own = climbed(best[1], steps)
        bounds.append(own[-1])
    w = q.weights()
    kept = np.flatnonzero(w > least)
    kept = kept[np.argsort(q.m[kept], kind="stable")]
    deviation = np.sqrt(q.rate[kept] / q.shape[kept])
    return [(q.m[kept] * unit + shift).tolist(), (deviation * unit).tolist(), (w[kept] / w[kept].sum()).tolist()], bounds
