"""Mixtures, marginals, sums of products and draws against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import marginals as M
from tabweave.functions import normal
from tabweave.functions.gram import correlation, covariance, covariances, gram_rows
from tabweave.functions.mixtures import dirichlet_mixture
from tabweave.operators import encode, fidelity, sampling


def column(spark, x, name="x"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"id long, {name} double")


PLANTED = [[(0, 1, 0.5), (10, 2, 0.3), (-20, 0.5, 0.2)], [(3, 1, 1.0)], [(0, 1, 0.6), (8, 1, 0.4)]]


@pytest.mark.parametrize("planted", PLANTED)
@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_planted_mixtures_are_found(planted, scale):
    """As many components as were planted, near them; the bound never falls and beats that of one normal."""
    rng = np.random.default_rng(1)
    x = scale * np.concatenate([rng.normal(m, s, int(6_000 * w)) for m, s, w in planted])
    (mu, sd, w), bounds = dirichlet_mixture(x, np.ones(len(x)))
    assert len(mu) == len(planted) and np.diff(bounds).min() > -1e-9
    for (m, s, share), a, b, c in zip(sorted(planted), mu, sd, w):
        # the priors of mean and precision count for one row each
        s = math.sqrt(s * s + ((x / scale).var() + (m - (x / scale).mean()) ** 2) / (len(x) * share))
        assert a == pytest.approx(scale * m, abs=0.1 * scale * max(s, 1)) and b == pytest.approx(scale * s, rel=0.1) and c == pytest.approx(share, abs=0.02)
    one = dirichlet_mixture(x, np.ones(len(x)), components=1)[1][-1]
    assert bounds[-1] >= one - 1e-3 and (len(planted) == 1 or bounds[-1] > one + 0.1)
    # binned points with their spread give the same fit
    bins = np.digitize(x, np.linspace(x.min(), x.max(), 2000))
    points = [(x[bins == b].mean(), (bins == b).sum(), x[bins == b].var()) for b in np.unique(bins)]
    (mu2, sd2, w2), _ = dirichlet_mixture(*map(np.array, zip(*[(p[0], p[1]) for p in points])), v=np.array([p[2] for p in points]))
    assert np.allclose(mu, mu2, atol=0.05 * scale) and np.allclose(sd, sd2, rtol=0.05) and np.allclose(w, w2, atol=0.01)


def test_bounds_of_one_normal():
    """With one component the bound is the evidence of a normal with a conjugate prior, which is known."""
    rng = np.random.default_rng(2)
    x = rng.normal(5, 3, 50)
    z = (x - x.mean()) / x.std()
    n = len(z)
    # evidence of z under Normal(0, 1 / precision) for the mean and Gamma(1/2, 1/2) for the precision, in units of the column; one stick of Beta(1, 0.001)
    shape, rate = 0.5 + n / 2, 0.5 + 0.5 * ((z - z.mean()) ** 2).sum() + 0.5 * n / (1 + n) * z.mean() ** 2
    known = math.lgamma(shape) - math.lgamma(0.5) + 0.5 * math.log(0.5) - shape * math.log(rate) - 0.5 * math.log(1 + n) - n / 2 * math.log(2 * math.pi)
    stick = math.lgamma(1 + n) + math.lgamma(0.001) - math.lgamma(1.001 + n) - (math.lgamma(1) + math.lgamma(0.001) - math.lgamma(1.001))
    assert dirichlet_mixture(x, np.ones(n), components=1)[1][-1] * n == pytest.approx(known + stick, rel=1e-9)


@pytest.mark.parametrize("scale", [1.0, 1000.0, 1e-3])
def test_draws_follow_the_posterior_at_every_scale(spark, scale):
    """C17: a drawn component is one that can have made the value; results do not change with the column's unit."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 1, 2000), rng.normal(40, 5, 1000)])
    enc = encode.ModeNormaliser(["x"], pick="draw", id_col="id").fit(column(spark, x * scale))
    rows = enc.transform(column(spark, x * scale)).orderBy("id").collect()
    mu, sd, w = (np.array(v) for v in enc.modes["x"])
    log = np.log(w / sd) - 0.5 * ((x[:, None] * scale - mu) / sd) ** 2
    share = np.exp(log - log.max(1, keepdims=True))
    share = share / share.sum(1, keepdims=True) + 1e-6
    mode = np.array([r["x_mode"] for r in rows])
    drawn = share[np.arange(len(x)), mode]
    assert (drawn < 1e-3).mean() < 0.002 and np.mean([abs(r["x_value"]) >= 0.99 for r in rows]) < 0.002
    # components are drawn as often as the posterior says
    for k in range(len(mu)):
        want = share[:, k] / share.sum(1)
        assert (mode == k).sum() == pytest.approx(want.sum(), abs=5 * math.sqrt((want * (1 - want)).sum()) + 2)


def test_mode_normaliser_of_odd_columns(spark):
    df = spark.createDataFrame([(i, None, 7.0, float(i % 2)) for i in range(40)], "id long, none double, one double, two double")
    enc = encode.ModeNormaliser(["none", "one", "two"]).fit(df)
    assert set(enc.modes) == {"one", "two"}
    back = enc.inverse(enc.transform(df)).orderBy("id").collect()
    assert all(r["one"] == pytest.approx(7) for r in back) and [round(r["two"]) for r in back] == [i % 2 for i in range(40)]
    assert encode.ModeNormaliser(["none"]).fit(df).modes == {}


# ---------------------------------------------------------------- marginals


def climb(f, start, steps=4000):
    """A plain optimiser: coordinate steps that double after a gain and halve after none."""
    p, step, best = np.array(start, float), np.full(len(start), 0.1), f(start)
    for _ in range(steps):
        for k in range(len(p)):
            for sign in (1, -1):
                q = p.copy()
                q[k] += sign * step[k]
                v = f(q)
                if v > best:
                    p, best, step[k] = q, v, step[k] * 2
                    break
            else:
                step[k] /= 2
        if step.max() < 1e-11:
            break
    return p, best


def scaled(x):
    d = (x.max() - x.min()) / (2 * len(x))
    return (x - x.min() + d) / (x.max() - x.min() + 2 * d), x.min() - d, x.max() - x.min() + 2 * d


def test_beta_equals_a_plain_optimiser(spark):
    x = 5 + 3 * np.random.default_rng(4).beta(2.0, 5.0, 1500)
    got = encode.GaussianNormaliser(["x"], "beta").fit(column(spark, x)).learned()["x"]
    z, lo, width = scaled(x)
    like = lambda p: -1e300 if min(p) <= 0 else (p[0] - 1) * np.log(z).mean() + (p[1] - 1) * np.log1p(-z).mean() - math.lgamma(p[0]) - math.lgamma(p[1]) + math.lgamma(p[0] + p[1]) - math.log(width)
    p, best = climb(like, (1.0, 1.0))
    assert got["params"][:2] == pytest.approx(p, rel=1e-4) and got["params"][2:] == pytest.approx([lo, width]) and got["log_likelihood"] == pytest.approx(best)


def test_gamma_equals_a_plain_optimiser(spark):
    x = np.random.default_rng(5).gamma(3.0, 2.0, 1500) - 4
    got = encode.GaussianNormaliser(["x"], "gamma").fit(column(spark, x)).learned()["x"]
    z, lo, width = scaled(x)
    y = z * width
    like = lambda p: -1e300 if min(p) <= 0 else (p[0] - 1) * np.log(y).mean() - y.mean() / p[1] - p[0] * math.log(p[1]) - math.lgamma(p[0])
    p, best = climb(like, (1.0, 1.0))
    assert [got["params"][0], got["params"][2]] == pytest.approx(p, rel=1e-4) and got["params"][1] == pytest.approx(lo) and got["log_likelihood"] == pytest.approx(best)


def test_truncated_normal_equals_a_plain_optimiser(spark):
    x = np.random.default_rng(6).normal(0.7, 0.4, 6000)
    x = x[(x > 0) & (x < 1)]
    got = encode.GaussianNormaliser(["x"], "truncnorm").fit(column(spark, x)).learned()["x"]
    z, lo, width = scaled(x)
    cut = lambda m, s: 0.5 * (math.erf((1 - m) / s / math.sqrt(2)) - math.erf(-m / s / math.sqrt(2)))
    like = lambda p: -1e300 if p[1] <= 0 else -0.5 * (((z - p[0]) / p[1]) ** 2).mean() - math.log(p[1] * math.sqrt(2 * math.pi) * max(cut(*p), 1e-300)) - math.log(width)
    p, best = climb(like, (0.5, 0.3))
    assert got["params"][:2] == pytest.approx([lo + width * p[0], width * p[1]], rel=1e-4) and got["log_likelihood"] == pytest.approx(best, rel=1e-6)


def test_the_family_is_chosen(spark):
    rng = np.random.default_rng(7)
    data = {"norm": rng.normal(3, 2, 4000), "uniform": rng.uniform(-1, 4, 4000), "gamma": rng.gamma(0.7, 2, 4000), "beta": rng.beta(0.4, 0.5, 4000)}
    names = list(data)
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*data.values())], ", ".join(f"{n} double" for n in names))
    got = encode.GaussianNormaliser(names, "best").fit(df).learned()
    assert {n: got[n]["kind"] for n in names} == {n: n for n in names}
    fixed = {k: encode.GaussianNormaliser(names, k).fit(df).learned() for k in M.FAMILIES}
    for n in names:
        score = {k: 4000 * f[n]["log_likelihood"] - 0.5 * M.FAMILIES[k] * math.log(4000) for k, f in fixed.items()}
        assert got[n]["log_likelihood"] == fixed[n][n]["log_likelihood"] and max(score, key=score.get) == n


def test_scores_of_marginals(spark):
    """Encoded values are the normal scores of the fitted distribution."""
    x = np.random.default_rng(8).beta(2.0, 3.0, 800)
    df = column(spark, x)
    z, *_ = scaled(x)
    score = {r["id"]: r["x"] for r in encode.GaussianNormaliser(["x"], "norm").fit(df).transform(df).collect()}
    assert [score[i] for i in range(800)] == pytest.approx((x - x.mean()) / x.std(), abs=2e-3)
    enc = encode.GaussianNormaliser(["x"], "beta").fit(df)
    a, b = enc.learned()["x"]["params"][:2]
    grid = np.linspace(0, 1, 200_001)
    mid = (grid[1:] + grid[:-1]) / 2
    cdf = np.append(0, np.cumsum(mid ** (a - 1) * (1 - mid) ** (b - 1)))
    want = np.interp(z, grid, cdf / cdf[-1])
    score = {r["id"]: r["x"] for r in enc.transform(df).collect()}
    assert np.abs(normal.cdf(np.array([score[i] for i in range(800)])) - want).max() < 1e-4
    kde = encode.GaussianNormaliser(["x"], "gaussian_kde").fit(df)
    (h,) = kde.learned()["x"]["params"]
    assert h == pytest.approx(x.std(ddof=1) * 800**-0.2)
    want = normal.ppf(normal.cdf((x[:, None] - x[None]) / h).mean(1))
    encoded = kde.transform(df)
    assert np.abs(normal.cdf(np.array([r["x"] for r in encoded.orderBy("id").collect()])) - normal.cdf(want)).max() < 1e-4
    assert np.abs(np.array([r["x"] for r in kde.inverse(encoded).orderBy("id").collect()]) - x).max() < 1e-3


def test_rank_gauss_values(spark):
    """Encoded values against plain quantiles."""
    x = np.random.default_rng(9).exponential(size=700)
    enc = encode.RankGauss(["x"], points=101).fit(column(spark, x))
    refs = np.array(enc.refs["x"])
    assert np.abs(np.searchsorted(np.sort(x), refs, side="right") / 700 - np.linspace(0, 1, 101)).max() < 0.01
    p = np.interp(x, refs, np.linspace(0, 1, 101))
    got = {r["id"]: r["x"] for r in enc.transform(column(spark, x)).collect()}
    assert [got[i] for i in range(700)] == pytest.approx(normal.ppf(np.clip(p, 1e-7, 1 - 1e-7)), abs=1e-6)


# ---------------------------------------------------------------- sums of products


def holed(rng, n, d, holes=0.2):
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 1000
    x[rng.random((n, d)) < holes] = np.nan
    x[:, -1] = 7.0
    return x


def wide(spark, x, extra=()):
    names = [f"c{k}" for k in range(x.shape[1])]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], *(e[i] for e in extra)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join([f"{n} double" for n in names] + (["src string"] if extra else []))), names


def test_gram_matches_pairs(spark):
    x = holed(np.random.default_rng(10), 300, 10)
    df, names = wide(spark, x)
    got = {(r["i"], r["j"]): r for r in gram_rows(df.repartition(5), names).select("i", "j", "n", correlation().alias("r"), covariance().alias("c")).collect()}
    assert len(got) == 100
    for i in range(10):
        for j in range(10):
            a, b = x[:, i], x[:, j]
            ok = ~np.isnan(a) & ~np.isnan(b)
            r = got[(i, j)]
            assert r["n"] == ok.sum() and r["c"] == pytest.approx(np.cov(a[ok], b[ok])[0, 1], abs=1e-9)
            assert r["r"] is None if 9 in (i, j) else r["r"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1])
    one = df.agg(*[F.corr(names[0], n).alias(n) for n in names[1:9]]).first()
    assert all(one[n] == pytest.approx(got[(0, k + 1)]["r"]) for k, n in enumerate(names[1:9]))


def test_three_hundred_columns(spark):
    rng = np.random.default_rng(11)
    x = holed(rng, 120, 300)
    sides = ["real" if i % 2 else "fake" for i in range(120)]
    df, names = wide(spark, x, [sides])
    real, fake = df.where("src = 'real'").drop("src"), df.where("src = 'fake'").drop("src")
    rows = fidelity.pearson(real, fake, names).collect()
    assert len(rows) == 300 * 299 // 2
    for r in rows[:: len(rows) // 50]:
        i, j = int(r["c1"][1:]), int(r["c2"][1:])
        for side, got in (("real", r["r_real"]), ("fake", r["r_fake"])):
            a, b = (x[[s == side for s in sides], k] for k in (i, j))
            ok = ~np.isnan(a) & ~np.isnan(b)
            assert got is None if 299 in (i, j) else got == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1])
    mean, cov, cor = covariances(df, names)
    assert cov.shape == cor.shape == (300, 300) and np.allclose(cov, cov.T) and mean == pytest.approx(np.nanmean(x, 0))


def test_principal_axes(spark):
    """Scores, not only the way back."""
    x = np.random.default_rng(12).normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1]) @ np.linalg.qr(np.random.default_rng(13).normal(size=(4, 4)))[0]
    df, names = wide(spark, x)
    enc = encode.Pca(names, 0.99).fit(df)
    value, vector = np.linalg.eigh(np.cov(x.T))
    value, vector = value[::-1], vector[:, ::-1]
    k = int(np.searchsorted(np.cumsum(value / value.sum()), 0.99) + 1)
    vector = vector * np.where(vector[np.abs(vector).argmax(0), range(4)] < 0, -1, 1)
    got = np.array([tuple(r) for r in enc.transform(df).collect()])
    want = (x - x.mean(0)) @ vector[:, :k]
    assert got.shape == want.shape and np.allclose(got[np.argsort(got[:, 0])], want[np.argsort(want[:, 0])], atol=1e-6) and enc.explained == pytest.approx(value / value.sum())


def test_copula_correlation(spark):
    """Rows drawn keep rank correlation and bounds, and their number."""
    rng = np.random.default_rng(14)
    a = rng.normal(size=2000)
    df = spark.createDataFrame([(float(np.exp(u)), float(u + 0.5 * v)) for u, v in zip(a, rng.normal(size=2000))], "x double, y double")
    rows = sampling.copula_sample(df, ["x", "y"], marginal={"x": "gamma", "y": "norm"}).collect()
    x = np.array([(r["x"], r["y"]) for r in rows])
    ranks = lambda v: np.argsort(np.argsort(v))
    real = np.corrcoef(a, [r["y"] for r in df.collect()])[0, 1]
    assert len(rows) == 2100 and np.corrcoef(ranks(x[:, 0]), ranks(x[:, 1]))[0, 1] == pytest.approx(real, abs=0.08)


# ---------------------------------------------------------------- draws


def test_draws_from_a_large_vocabulary(spark):
    """The first category whose cumulated share exceeds the draw, for 50,000 categories and a hot one."""
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50_000).cast("string")).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    freq = sampling.frequencies(df, ["c", "d"], log=False)
    drawn = sampling.draw_conditions(spark, freq, 6000)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    table = {}
    for r in freq.collect():
        table.setdefault(r["col"], []).append((r["cum"], r["value"], r["prob"]))
    from tabweave.functions.order import uniform

    us = {r["draw"]: (r["a"], r["b"]) for r in spark.range(6000).withColumnRenamed("id", "draw").select("draw", uniform("42|col", "draw").alias("a"), uniform("42|value", "draw").alias("b")).collect()}
    rows = drawn.collect()
    assert sorted(r["draw"] for r in rows) == list(range(6000))
    ends = {c: np.array([x[0] for x in sorted(t)]) for c, t in table.items()}
    names = {c: [x[1] for x in sorted(t)] for c, t in table.items()}
    for c, t in table.items():
        assert sorted(t) == sorted(t, key=lambda x: x[1]) and max(x[0] for x in t) == 1.0 and sum(x[2] for x in t) == pytest.approx(1)
    for r in rows:
        a, b = us[r["draw"]]
        c = ["c", "d"][int(a * 2)]
        assert r["col"] == c and r["value"] == names[c][int(np.searchsorted(ends[c], b, side="right"))]
