"""Likelihood fits of one-dimensional marginals from sums over a table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import normal
from .special import digamma, lgamma, trigamma

#: Families among which ``best`` chooses, with how many numbers each takes from the data.
FAMILIES = {"norm": 2, "uniform": 2, "truncnorm": 4, "gamma": 3, "beta": 4}
#: Bins of a kernel estimate.
BINS = 4096
_POINTS = 4097


def fit_gamma(mean: float, mean_log: float) -> tuple[float, float]:
    """(shape, scale) from the mean and the mean log: Newton steps on log k - digamma(k) = log mean - mean log."""
    gap = max(math.log(mean) - mean_log, 1e-12)
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        step = (math.log(k) - float(digamma(k)) - gap) / (1 / k - float(trigamma(k)))
        new = k - step
        k = new if new > 0 else k / 2
        if abs(step) < 1e-12 * k:
            break
    return k, mean / k


def fit_beta(log_z: float, log_rest: float, mean: float, var: float) -> tuple[float, float]:
    """(a, b) from the means of log z and log(1 - z), started at the moments: Newton steps on the two equations of the likelihood."""
    s = max(mean * (1 - mean) / max(var, 1e-12) - 1, 0.1)
    p = np.array([max(mean * s, 1e-3), max((1 - mean) * s, 1e-3)])
    want = np.array([log_z, log_rest])
    for _ in range(200):
        both = p.sum()
        grad = digamma(p) - digamma(both) - want
        shared, own = float(trigamma(both)), trigamma(p)
        # the matrix is own on its diagonal less the shared part everywhere
        hess = np.diag(own) - shared
        step = np.linalg.solve(hess, grad)
        new = p - step
        while (new <= 0).any():
            step /= 2
            new = p - step
        p = new
        if np.abs(step).max() < 1e-12 * p.max():
            break
    return float(p[0]), float(p[1])


def fit_truncnorm(mean: float, var: float, points: int = 2001) -> tuple[float, float]:
    """(mu, sigma) of a normal cut to [0, 1] whose mean and variance are these: Newton steps in its natural parameters.

    Where the likelihood rises without end (flat or hollow data), sigma stops at 1000.
    """
    x = np.linspace(0, 1, points)
    w = np.full(points, 2.0)
    w[1::2] = 4
    w[0] = w[-1] = 1  # Simpson's rule
    t = np.stack([x, x * x])
    want = np.array([mean, var + mean * mean])
    flattest = -1 / (2 * 1000.0**2)
    theta = np.array([mean / max(var, 1e-9), -1 / (2 * max(var, 1e-9))])
    value = lambda th: (m := (e := th @ t).max()) + math.log((w * np.exp(e - m)).sum()) - th @ want
    for _ in range(500):
        e = theta @ t
        share = w * np.exp(e - e.max())
        share /= share.sum()
        moment = t @ share
        grad = moment - want
        hess = (t * share) @ t.T - np.outer(moment, moment)
        step = np.linalg.solve(hess + 1e-14 * np.eye(2), grad)
        size, now = 1.0, value(theta)
        while size > 1e-8 and value(theta - size * step) > now + 1e-15:
            size /= 2
        theta = theta - size * step
        if theta[1] > flattest:
            theta = np.array([max(min(theta[0], 2e3 * -flattest), -2e3 * -flattest), flattest])
            break
        if np.abs(size * step).max() < 1e-11 * (1 + np.abs(theta).max()):
            break
    sigma = math.sqrt(-0.5 / theta[1])
    return float(theta[0] * sigma * sigma), sigma


def tabulated(log_density, lo: float, hi: float) -> tuple[list[float], list[float]]:
    """Grid and distribution function of an unnormalised log density on [lo, hi]."""
    x = np.linspace(lo, hi, _POINTS)
    log = log_density((x[1:] + x[:-1]) / 2)
    p = np.append(0, np.cumsum(np.exp(log - log.max())))
    return x.tolist(), (p / p[-1]).tolist()


def _fitted(kind: str, s: dict) -> tuple[list[float], float, tuple]:
    """(parameters, log-likelihood a row, table) of a family, from sums over a column scaled to z in (0, 1) by its widened bounds."""
    lo, width = s["low"], s["width"]
    mean, var = s["z"], max(s["zz"] - s["z"] ** 2, 1e-18)
    if kind == "uniform":
        return [s["lo"], s["hi"]], -math.log(max(s["hi"] - s["lo"], 1e-300)), ([s["lo"], max(s["hi"], s["lo"] + 1e-9)], [0.0, 1.0])
    if kind == "norm":
        mu, sd = lo + width * mean, width * math.sqrt(var)
        return [mu, sd], -0.5 * math.log(2 * math.pi * sd * sd) - 0.5, tabulated(lambda x: -0.5 * ((x - mu) / sd) ** 2, mu - 8 * sd, mu + 8 * sd)
    if kind == "gamma":
        k, theta = fit_gamma(mean, s["log_z"])
        like = (k - 1) * s["log_z"] - mean / theta - k * math.log(theta) - float(lgamma(k)) - math.log(width)
        end = max(1.0, mean + 12 * math.sqrt(k) * theta)
        return [k, lo, theta * width], like, tabulated(lambda x: (k - 1) * np.log((x - lo) / width) - (x - lo) / width / theta, lo, lo + end * width)
    if kind == "beta":
        a, b = fit_beta(s["log_z"], s["log_rest"], mean, var)
        like = (a - 1) * s["log_z"] + (b - 1) * s["log_rest"] - float(lgamma(a) + lgamma(b) - lgamma(a + b)) - math.log(width)
        return [a, b, lo, width], like, tabulated(lambda x: (a - 1) * np.log((x - lo) / width) + (b - 1) * np.log1p(-(x - lo) / width), lo, lo + width)
    if kind == "truncnorm":
        mu, sd = fit_truncnorm(mean, var)
        inside = float(normal.cdf((1 - mu) / sd) - normal.cdf(-mu / sd))
        grid = np.linspace(0, 1, 2001)
        area = np.trapezoid(np.exp(-0.5 * ((grid - mu) / sd) ** 2), grid) if inside < 1e-9 else inside * sd * math.sqrt(2 * math.pi)
        like = -0.5 * ((mean - mu) ** 2 + var) / sd**2 - math.log(max(area, 1e-300)) - math.log(width)
        m, d = lo + width * mu, width * sd
        return [m, d, lo, lo + width], like, tabulated(lambda x: -0.5 * ((x - m) / d) ** 2, lo, lo + width)
    raise ValueError(f"unknown marginal {kind}")


def kernel_table(x: np.ndarray, n: np.ndarray, width: float) -> tuple[list[float], list[float]]:
    """Grid and distribution function of a kernel estimate: each point's mass is spread as a normal of deviation ``width``."""
    grid = np.linspace(x.min() - 5 * width, x.max() + 5 * width, _POINTS)
    cdf = np.zeros(len(grid))
    for lo in range(0, len(x), 256):
        cdf += (n[lo : lo + 256, None] * normal.cdf((grid[None, :] - x[lo : lo + 256, None]) / width)).sum(0)
    return grid.tolist(), np.maximum.accumulate(cdf / n.sum()).tolist()


def fitted_marginals(df: DataFrame, kinds: dict[str, str]) -> dict[str, dict]:
    """For each column its family, parameters, log-likelihood a row, table, mean, std, lo and hi.

    Two passes over the table: bounds and moments, then means of z, z^2, log z and
    log(1 - z), z being the value scaled to its bounds.  Bounds are widened by half a row's
    share of the range, so that the ends have finite logs.  Parameters: norm (mean, sd);
    uniform (lo, hi); gamma (shape, lo, scale); beta (a, b, lo, width); truncnorm (mu,
    sigma, lo, hi).  A column without values, or with one value, is uniform about it.
    """
    x = {c: F.col(c).cast("double") for c in kinds}
    share = np.linspace(0, 1, 1001).tolist()
    first = df.agg(*[a for c in kinds for a in (F.count(x[c]).alias(f"n_{c}"), F.avg(x[c]).alias(f"mean_{c}"), F.stddev_samp(x[c]).alias(f"std_{c}"), F.min(x[c]).alias(f"lo_{c}"), F.max(x[c]).alias(f"hi_{c}"), *([F.percentile_approx(x[c], share, 10_000).alias(f"q_{c}")] if kinds[c] == "empirical" else []))]).first()
    told = {c: {k: float(first[f"{k}_{c}"] or 0.0) for k in ("n", "mean", "std", "lo", "hi")} for c in kinds}
    wide = {c: (t["lo"] - d, t["hi"] - t["lo"] + 2 * d) for c, t in told.items() if t["hi"] > t["lo"] and (d := (t["hi"] - t["lo"]) / (2 * max(t["n"], 1.0)))}
    sums = {}
    if wide:
        z = {c: (x[c] - F.lit(lo)) / F.lit(w) for c, (lo, w) in wide.items()}
        one = df.agg(*[a for c in wide for a in (F.avg(z[c]).alias(f"z_{c}"), F.avg(z[c] * z[c]).alias(f"zz_{c}"), F.avg(F.ln(z[c])).alias(f"log_z_{c}"), F.avg(F.log1p(-z[c])).alias(f"log_rest_{c}"))]).first()
        sums = {c: told[c] | {k: one[f"{k}_{c}"] for k in ("z", "zz", "log_z", "log_rest")} | {"low": lo, "width": w} for c, (lo, w) in wide.items()}
    kernels = _kernels(df, {c: told[c] for c, k in kinds.items() if k == "gaussian_kde" and c in wide})
    out = {}
    for c, kind in kinds.items():
        params, like, table = [told[c]["lo"], told[c]["hi"]], None, ([told[c]["lo"], max(told[c]["hi"], told[c]["lo"] + 1e-9)], [0.0, 1.0])
        if kind == "empirical" and told[c]["n"]:
            params, table = [], (list(first[f"q_{c}"]), share)
        elif c not in sums:
            kind = "uniform" if kind in ("best", *FAMILIES) else kind
        elif kind == "gaussian_kde":
            params, table = [kernels[c][0]], kernels[c][1]
        elif kind == "best":
            fits = {k: _fitted(k, sums[c]) for k in FAMILIES}
            # the Bayesian information criterion: each number taken from the data costs half the log of the rows
            rows = told[c]["n"]
            kind = max(fits, key=lambda k: rows * fits[k][1] - 0.5 * FAMILIES[k] * math.log(rows))
            params, like, table = fits[kind]
        else:
            params, like, table = _fitted(kind, sums[c])
        out[c] = {k: told[c][k] for k in ("mean", "std", "lo", "hi")} | {"kind": kind, "params": params, "log_likelihood": like, "grid": table[0], "cdf": table[1]}
    return out


def _kernels(df: DataFrame, told: dict[str, dict]) -> dict[str, tuple]:
    """(bandwidth, table) by Scott's rule, from at most ``BINS`` bins a column."""
    if not told:
        return {}
    x = {c: F.col(c).cast("double") for c in told}
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.least(F.lit(BINS - 1), F.floor((x[c] - t["lo"]) / ((t["hi"] - t["lo"]) / BINS))).cast("int").alias("bin"), x[c].alias("x")) for c, t in told.items()])
    rows = df.select(F.explode(cells).alias("v")).select("v.*").where("x is not null").groupBy("col", "bin").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).orderBy("col", "bin").collect()  # BINS a column
    out = {}
    for c, t in told.items():
        own = [(r["x"], r["n"]) for r in rows if r["col"] == c]
        width = t["std"] * t["n"] ** -0.2
        out[c] = (width, kernel_table(np.array([v for v, _ in own]), np.array([float(n) for _, n in own]), width))
    return out
