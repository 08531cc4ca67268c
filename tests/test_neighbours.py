"""Neighbours, replicates, densities and predicates against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import neighbours as N
from tabweave.functions.order import uniform
from tabweave.operators import privacy


def table(spark, x, cats=None, first=0):
    cols = ", ".join([f"x{k} double" for k in range(x.shape[1])] + (["c string"] if cats is not None else []))
    rows = [(first + i, *[None if np.isnan(v) else float(v) for v in r], *([cats[i]] if cats is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, {cols}")


def brute(a, b, k, metric="l2", ca=None, cb=None, exclude_self=False):
    out = {}
    for i in range(len(a)):
        d = np.abs(a[i] - b) if metric == "gower" else (a[i] - b) ** 2
        d = d.sum(1) + (0 if ca is None else np.array([ca[i] != c for c in cb]))
        d = np.sqrt(d) if metric == "l2" else d
        if exclude_self:
            d[i] = np.inf
        order = [j for j in np.lexsort((np.arange(len(b)), d)) if np.isfinite(d[j])][:k]
        out[i] = [(int(j), d[j]) for j in order]
    return out


def clustered(rng, n, d, clusters=8):
    """Clusters, copies of one row in a third of all rows, and a few far rows."""
    x = rng.normal(size=(n, d)) * 0.3 + rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] * 20
    x[: n // 3] = x[0]
    return x[rng.permutation(n)]


@pytest.mark.parametrize("metric, cats", [("l2", False), ("gower", False), ("gower", True)])
@pytest.mark.parametrize("size", [1 << 26, 3000])
def test_neighbours_match_brute_force(spark, metric, cats, size):
    """One block, and blocks round pivots; copies in a third of the rows, nulls, ties."""
    rng = np.random.default_rng(3)
    a, b = clustered(rng, 240, 3), clustered(rng, 300, 3)
    a[5] = b[7]
    ca, cb = ([["u", "v", None][k] for k in rng.integers(3, size=n)] for n in (240, 300)) if cats else (None, None)
    a[9, 1] = b[11, 2] = np.nan
    cols = ["x0", "x1", "x2"]
    got = N.knn_topk(table(spark, a, ca), table(spark, b, cb), "id", "id", cols, 4, ["c"] if cats else [], metric, block_bytes=size).collect()
    want = brute(a, b, 4, metric, ca, cb)
    by = {}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        by.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    assert 9 not in by and set(by) == set(range(240)) - {9}
    for i in by:
        assert [j for j, _ in by[i]] == [j for j, _ in want[i]] and np.allclose([d for _, d in by[i]], [d for _, d in want[i]])


@pytest.mark.parametrize("size", [1 << 26, 2500])
def test_a_row_is_not_its_own_neighbour(spark, size):
    x = clustered(np.random.default_rng(4), 200, 2)
    df = table(spark, x)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in N.knn_topk(df, df, "id", "id", ["x0", "x1"], 2, exclude_self=True, block_bytes=size).collect()}
    assert got == {(i, k + 1): j for i, near in brute(x, x, 2, exclude_self=True).items() for k, (j, _) in enumerate(near)}


def test_few_pairs_are_compared(spark):
    """On clustered data a small part of all pairs is looked at, in one block and in many."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 4)) * 0.5 + rng.normal(size=(40, 4))[rng.integers(40, size=8000)] * 30
    df = table(spark, x)
    for size in (1 << 26, 60_000):
        pairs = spark.sparkContext.accumulator(0)
        N.knn_topk(df, df, "id", "id", [f"x{k}" for k in range(4)], 2, exclude_self=True, block_bytes=size, compared=pairs).count()
        assert 8000 < pairs.value < 0.35 * 8000 * 8000


def plain_bootstrap(real, fake, ids, replicates, share, seed):
    out = {}
    for b in range(replicates):
        r, f = real[ids["r"][b]], fake[ids["f"][b]]
        if not len(r) or not len(f):
            continue
        scale = lambda x: (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        d = np.sort(np.sqrt(((scale(r)[:, None] - scale(f)[None]) ** 2).sum(2)), axis=1)
        ratio = d[:, 0] / d[:, 1] if d.shape[1] > 1 else np.zeros(0)
        out[b] = (np.percentile(d[:, 0], 5), np.percentile(ratio, 5) if len(ratio) else None)
    return out


@pytest.mark.parametrize("size", [1 << 26, 20_000])
def test_bootstrap_matches_brute_force(spark, sf_dir, monkeypatch, size):
    """G7 over the real embeddings: samples, scaling, distances and percentiles of every replicate."""
    from tabweave.plans.fixtures import ALL_COLS, vectors

    monkeypatch.setattr(N.replicate_distances, "__defaults__", (size,))
    v = vectors(spark, sf_dir)
    real, fake = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    replicates, share = (100, 0.15) if size > 1 << 20 else (7, 0.3)
    got = {r["replicate"]: (r["dcr_5"], r["nndr_5"]) for r in privacy.bootstrap_dcr_nndr(real, fake, "vec_id", ALL_COLS, replicates, share).collect()}
    data, ids = {}, {}
    for side, df in (("r", real), ("f", fake)):
        rows = df.orderBy("vec_id").collect()
        data[side] = np.array([[r[c] for c in ALL_COLS] for r in rows])
        drawn = df.select("vec_id", *[(uniform(f"42|{side}|{b}", "vec_id") < share).alias(f"in{b}") for b in range(replicates)]).orderBy("vec_id").collect()
        ids[side] = np.array([r[1:] for r in drawn]).T
    want = plain_bootstrap(data["r"], data["f"], ids, replicates, share, 42)
    assert got.keys() == want.keys() and len(got) == replicates
    for b, (dcr, nndr) in want.items():
        assert got[b][0] == pytest.approx(dcr) and got[b][1] == pytest.approx(nndr)


def test_bootstrap_of_few_rows(spark):
    df = table(spark, np.array([[1.0, 2.0], [3.0, np.nan], [5.0, 6.0]]))
    rows = privacy.bootstrap_dcr_nndr(df, df, "id", ["x0", "x1"], replicates=20, share=0.5).collect()
    assert len({r["replicate"] for r in rows}) == len(rows) <= 20
    assert privacy.bootstrap_dcr_nndr(df.limit(0), df, "id", ["x0", "x1"], replicates=5).count() == 0


def plain_density(z, y):
    d = y.shape[1]
    cov = np.cov(y.T) * len(y) ** (-2 / (d + 4))
    inv = np.linalg.inv(cov)
    gap = z[:, None] - y[None]
    return np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", gap, inv, gap)).sum(1) / (len(y) * (2 * np.pi) ** (d / 2) * np.sqrt(np.linalg.det(cov)))


@pytest.mark.parametrize("size", [1 << 26, 9000])
def test_densities_keep_their_error(spark, size):
    rng = np.random.default_rng(6)
    y, z = clustered(rng, 1500, 2), np.concatenate([clustered(rng, 200, 2), rng.normal(size=(20, 2)) * 60])
    sample, points = table(spark, y), table(spark, z)
    want = plain_density(z, y)
    for error, most in ((0.0, 1.0), (1e-7, 0.8), (1e-2, 0.5)):
        pairs = spark.sparkContext.accumulator(0)
        got = {r["id"]: r["density"] for r in N.kde(points, sample, "id", ["x0", "x1"], error=error, block_bytes=size, compared=pairs).collect()}
        got = np.array([got[i] for i in range(len(z))])
        assert (np.abs(got - want) <= (error + 1e-9) * want).all() and pairs.value <= most * len(y) * len(z)


def test_predicates_match_brute_force(spark):
    """10,000 predicates over rows with nulls: counts up to two, blocks of bit sets, early ends."""
    from tabweave.functions.predicates import match_counts

    rng = np.random.default_rng(8)
    rows = [(None if rng.random() < 0.1 else float(rng.integers(30)), None if rng.random() < 0.1 else int(rng.integers(9)), [None, "u", "v", "w"][rng.integers(4)]) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y int, c string").repartition(3)
    preds = []
    for _ in range(10_000):
        p = [("x", str(rng.choice(["<=", ">="])), float(rng.integers(30)) + rng.choice([0, 0.5]))] if rng.random() < 0.7 else []
        p += [("y", str(rng.choice(["<=", ">="])), int(rng.integers(9)))] if rng.random() < 0.7 else []
        p += [("c", "=", str(rng.choice(["u", "v", "w", "none"])))] if rng.random() < 0.7 else []
        preds.append(p)
    ok = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    name = {"x": 0, "y": 1, "c": 2}
    got = {r["k"]: r["m"] for r in match_counts(df, preds, ["x", "y", "c"]).collect()}
    for k, p in enumerate(preds):
        want = sum(all(r[name[c]] is not None and ok[o](r[name[c]], v) for c, o, v in p) for r in rows) if p else 0
        assert min(got.get(k, 0), 2) == min(want, 2), p
    assert match_counts(df.limit(0), preds[:3], ["x", "y", "c"]).count() == 0


def test_singling_out_with_nulls(spark):
    """Nulls in all tables, a column of nulls only."""
    rows = [(i, None if i % 4 == 0 else float(i % 11), None, None if i % 5 == 0 else f"v{i % 7}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, none double, c string")
    for n in (1, 2, 3):
        r = privacy.singling_out_multivariate(df, df, df.where("id < 40"), "id", ["x", "none", "c"], n, 60).first()
        assert 0 < r["n"] <= 60 and r["attack_rate"] is not None


def test_attribution_lattice_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [(*[[None, "a", "b", "c"][k] for k in rng.integers(4, size=3)], int(rng.integers(3))) for _ in range(n)]
    real, fake = draw(60), [r for r in draw(25) if r[0] != "c"]
    shape = "k string, l string, m string, s int"
    score = 0.0
    for r in real:
        gaps = [sum(a != b for a, b in zip(r[:3], f[:3])) for f in fake]
        near = [f for f, g in zip(fake, gaps) if g == min(gaps)]
        score += sum(f[3] == r[3] for f in near) / len(near)
    got = privacy.generalised_cap(spark.createDataFrame(real, shape), spark.createDataFrame(fake, shape), ["k", "l", "m"], ["s"])
    assert got.first()[0] == pytest.approx(1 - score / len(real))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 4 and "Expand" in plan  # each table once for each of the joins' sides, whatever the number of key sets


def test_win_rate_error_is_that_of_a_bootstrap(spark):
    """The standard error over 1000 replicates is that of a multinomial, which is known."""
    from tabweave.operators import ranking

    rows = [("g", i, 0.0, float([1, 0, -1][(i % 10 > 5) + (i % 10 > 7)])) for i in range(500)] + [(None, 0, 1.0, 1.0), ("h", 1, 0.0, 1.0)]
    got = {r["g"]: r for r in ranking.win_rate(spark.createDataFrame(rows, "g string, id int, a double, b double"), ["g"], 1000).collect()}
    w = np.array([1.0] * 300 + [0.5] * 100 + [0.0] * 100)
    assert got["g"]["win_rate"] == pytest.approx(w.mean()) and got["g"]["se"] == pytest.approx(w.std() / math.sqrt(500), rel=0.08)
    assert got[None]["win_rate"] == 0.5 and got[None]["se"] == 0 and got["h"]["se"] == 0 and got["h"]["n"] == 1


def test_binomial_quantiles():
    from tabweave.functions import special

    u = np.random.default_rng(1).random(4000)
    for n, p in ((1, 0.3), (12, 0.5), (1000, 0.02), (10**7, 0.4)):
        k = special.binomial_quantile(u, n, p)
        assert k.mean() == pytest.approx(n * p, abs=5 * math.sqrt(n * p * (1 - p) / 4000)) and k.std() == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.1)
    exact = np.cumsum([math.comb(12, k) * 0.5**12 for k in range(13)])
    assert (special.binomial_quantile(u, 12, 0.5) == np.searchsorted(exact, u)).all()
    assert special.binomial_quantile(u[:3], 0, 0.5).tolist() == [0, 0, 0] and special.binomial_quantile(u[:2], 7, 1.0).tolist() == [7, 7]
