"""Gamma functions and binomial quantiles on arrays."""

from __future__ import annotations

import numpy as np


def _shifted(x: np.ndarray, least: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """x raised by whole steps to at least ``least``, and how many steps."""
    steps = np.maximum(np.ceil(least - x), 0)
    return x + steps, steps


def lgamma(x) -> np.ndarray:
    """log Gamma(x) for x > 0: Stirling's series above 12, the recurrence below."""
    x = np.asarray(x, float)
    y, steps = _shifted(x)
    i = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / y
    for k in range(int(steps.max(initial=0))):
        out = np.where(k < steps, out - np.log(np.where(k < steps, x + k, 1)), out)
    return out


def digamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    y, steps = _shifted(x)
    i = 1 / (y * y)
    out = np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    for k in range(int(steps.max(initial=0))):
        out = np.where(k < steps, out - 1 / np.where(k < steps, x + k, 1), out)
    return out


def trigamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    y, steps = _shifted(x)
    i = 1 / (y * y)
    out = 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))
    for k in range(int(steps.max(initial=0))):
        out = np.where(k < steps, out + 1 / np.where(k < steps, x + k, 1) ** 2, out)
    return out


def binomial_quantile(u: np.ndarray, n: int, p: float) -> np.ndarray:
    """The least k with P(X <= k) >= u for X binomial (n, p): sums of the exact shares within 12 deviations of the mean."""
    u = np.asarray(u, float)
    if n <= 0 or p <= 0:
        return np.zeros(len(u), np.int64)
    if p >= 1:
        return np.full(len(u), n, np.int64)
    reach = 12 * np.sqrt(n * p * (1 - p)) + 24
    k = np.arange(max(0, int(n * p - reach)), min(n, int(n * p + reach)) + 1)
    log = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * np.log(p) + (n - k) * np.log1p(-p)
    return k[np.minimum(np.searchsorted(np.cumsum(np.exp(log)), u), len(k) - 1)]
