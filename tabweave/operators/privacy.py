"""Section G: privacy risk of a synthetic table."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.neighbours import kde, knn_topk, replicate_distances
from ..functions.predicates import match_counts
from ..functions.order import numbered, numbered_by_value, quantile, seeded, uniform
from ..functions.scratch import settled
from .encode import Pca
from .sampling import single_rows

# --- G1-G4: clusters ----------------------------------------------------------------------------------

CLUSTERS = (2, 5, 10, 15)
START = 999


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip").transform(df.withColumns({c: F.col(c).cast("double") for c in cols}))


class Clusterings:
    """Clusterings of one table's columns, each fitted once however many metrics ask for it."""

    def __init__(self, df: DataFrame, cols: list[str], seed: int = 42):
        self.df, self.cols, self.seed, self.models, self._rows = df, cols, seed, {}, None

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def model(self, k: int):
        if k not in self.models:
            self.models[k] = KMeans(k=k, seed=self.seed, featuresCol="_v", predictionCol="cluster").fit(_assembled(self.df, self.cols))
        return self.models[k]


def cluster_sizes(fit_on: DataFrame, score: DataFrame, cols: list[str], k: int, keys: list[str] = (), fitted: Clusterings | None = None) -> DataFrame:
    """(cluster, n, n_keys): rows, and distinct key combinations, of each cluster that has rows; ``fitted`` holds clusterings of ``fit_on``."""
    model = (fitted or Clusterings(fit_on, cols)).model(k)
    aggs = [F.count(F.lit(1)).alias("n"), (F.count_distinct(F.struct(*keys)) if keys else F.lit(None).cast("long")).alias("n_keys")]
    return model.transform(_assembled(score, cols)).groupBy("cluster").agg(*aggs)


def _over_k(n: int, ks: tuple[int, ...]) -> list[int]:
    return [k for k in ks if n / k >= 10]


def _row(spark: SparkSession, metric: str, real: float, fake: float) -> DataFrame:
    return spark.createDataFrame([(metric, float(real), float(fake), bool(fake >= real))], "metric string, real double, fake double, safe boolean")


def _least(df: DataFrame, cols: list[str], keys: list[str], value: str, ks: tuple[int, ...], fitted: Clusterings | None) -> float:
    own = fitted or Clusterings(df, cols)
    return min([START, *(cluster_sizes(df, df, cols, k, keys, fitted=own).agg(F.min(value)).first()[0] for k in _over_k(own.rows, ks))])


def k_anonymity(real: DataFrame, fake: DataFrame, cols: list[str], ks: tuple[int, ...] = CLUSTERS, fitted: tuple[Clusterings | None, Clusterings | None] = (None, None)) -> DataFrame:
    """G1: the smallest cluster over several k, of clusterings of each table on its own; safe if fake's is not smaller."""
    return _row(real.sparkSession, "k_anonymity", *(_least(df, cols, [], "n", ks, own) for df, own in zip((real, fake), fitted)))


def l_diversity(real: DataFrame, fake: DataFrame, cols: list[str], keys: list[str], ks: tuple[int, ...] = CLUSTERS, fitted: tuple[Clusterings | None, Clusterings | None] = (None, None)) -> DataFrame:
    """The fewest distinct key combinations in a cluster."""
    return _row(real.sparkSession, "l_diversity", *(_least(df, cols, keys, "n_keys", ks, own) for df, own in zip((real, fake), fitted)))


def k_map(real: DataFrame, fake: DataFrame, cols: list[str], ks: tuple[int, ...] = CLUSTERS, fitted: Clusterings | None = None) -> DataFrame:
    """Clusters fitted to real; the smallest number of synthetic rows in one (empty ones do not count)."""
    own = fitted or Clusterings(real, cols)
    got = min([START, *(cluster_sizes(real, fake, cols, k, fitted=own).agg(F.min("n")).first()[0] or START for k in _over_k(own.rows, ks))])
    return real.sparkSession.createDataFrame([("k_map", float(got))], "metric string, value double")


def delta_presence(real: DataFrame, fake: DataFrame, cols: list[str], ks: tuple[int, ...] = CLUSTERS, fitted: Clusterings | None = None) -> DataFrame:
    """The largest ratio of real to synthetic rows in a cluster fitted to real; both sides are dealt by the same clusters."""
    own, best = fitted or Clusterings(real, cols), 0.0
    for k in _over_k(own.rows, ks):
        r, s = (cluster_sizes(real, df, cols, k, fitted=own).select("cluster", F.col("n").alias(n)) for df, n in ((real, "r"), (fake, "s")))
        best = max(best, r.join(s, "cluster", "left").agg(F.max(F.col("r") / (F.coalesce("s", F.lit(0)) + 1e-8))).first()[0])
    return real.sparkSession.createDataFrame([("delta_presence", float(best))], "metric string, value double")


# --- G5: equivalence classes --------------------------------------------------------------------------


def class_risk(real: DataFrame, fake: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """(metric, real, fake): exact k-anonymity and l-diversity of both tables, k-map and delta-presence, on key values."""
    def classes(df: DataFrame, n: str, l_: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.count_distinct(F.struct(*sensitive)).alias(l_))

    r, f = classes(real, "r", "rl"), classes(fake, "f", "fl").select(*[F.col(k).alias(f"_{k}") for k in keys], "f", "fl")
    both = r.join(f, reduce(lambda a, b: a & b, [r[k].eqNullSafe(f[f"_{k}"]) for k in keys]), "full")
    # k-map: among classes that real has, the synthetic rows; delta: the share of a class's rows that are real
    one = both.agg(F.min("r").alias("kr"), F.min("f").alias("kf"), F.min("rl").alias("lr"), F.min("fl").alias("lf"), F.min(F.when(F.col("r").isNotNull(), F.col("f"))).alias("km"), F.max(F.when(F.col("r").isNotNull(), F.col("r") / (F.coalesce("f", F.lit(0)) + 1e-8))).alias("dp"))
    none = F.lit(None).cast("double")
    rows = [("k_anonymity", F.col("kr"), F.col("kf")), ("l_diversity", F.col("lr"), F.col("lf")), ("k_map", none, F.col("km")), ("delta_presence", none, F.col("dp"))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), a.cast("double").alias("real"), b.cast("double").alias("fake")) for m, a, b in rows])).alias("x")).select("x.*")


# --- G6-G8: neighbours --------------------------------------------------------------------------------


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0)."""
    one = df.agg(*[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"] or 1.0) for c in cols})


def entropies(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Entropy (natural) of each column's rounded values."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.rint(F.col(c).cast("double")).alias("v")) for c in cols])).alias("x")).select("x.*")
    counts = cells.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    # -sum p ln p with p = n / total, in sums that need no table of a column's values in one place
    sums = counts.groupBy("col").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return {r["col"]: r["e"] for r in sums.select("col", (F.ln("total") - F.col("s") / F.col("total")).alias("e")).collect()}


def re_identification(real: DataFrame, fake: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Share of real rows whose nearest synthetic row is nearer than their nearest other real row, columns over their entropy."""
    w = entropies(real, cols)
    scaled = lambda df: df.withColumns({c: F.col(c).cast("double") / (w[c] + 1e-16) for c in cols})
    r, f = scaled(real), scaled(fake)
    own = knn_topk(r, r, id_col, id_col, cols, 1, exclude_self=True).select(id_col, F.col("distance").alias("own"))
    hat = knn_topk(r, f, id_col, id_col, cols, 1).select(id_col, F.col("distance").alias("hat"))
    return own.join(hat, id_col).agg(F.avg((F.col("hat") < F.col("own")).cast("double")).alias("re_identification"))


def record_distances(real: DataFrame, fake: DataFrame, id_col: str, cols: list[str], scale: bool = True, exclude_self: bool = False) -> DataFrame:
    """(id, dcr, nndr): distance of each real row to its closest synthetic row, and over that to the second."""
    a, b = (standardised(real, cols), standardised(fake, cols)) if scale else (real, fake)
    top = knn_topk(a, b, id_col, id_col, cols, 2, exclude_self=exclude_self)
    pair = top.groupBy(id_col).agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("dcr"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return pair.select(id_col, "dcr", F.try_divide("dcr", "second").alias("nndr"))


def fifth_percentiles(distances: DataFrame, exact: bool = True) -> DataFrame:
    """(dcr_5, nndr_5): exact by narrowing the range that holds the rank, or approximate in one pass."""
    if not exact:
        return distances.agg(*[F.percentile_approx(c, 0.05, 100_000).alias(f"{c}_5") for c in ("dcr", "nndr")])
    held = settled(distances, "distances")
    return distances.sparkSession.createDataFrame([(quantile(held, "dcr", 0.05), quantile(held, "nndr", 0.05))], "dcr_5 double, nndr_5 double")


def dcr_nndr(real: DataFrame, fake: DataFrame, id_col: str, cols: list[str], exact: bool = True) -> DataFrame:
    """5th percentiles of DCR and NNDR, each table standardised by itself."""
    return fifth_percentiles(record_distances(real, fake, id_col, cols), exact)


def bootstrap_dcr_nndr(real: DataFrame, fake: DataFrame, id_col: str, cols: list[str], replicates: int = 100, share: float = 0.15, seed: int = 42) -> DataFrame:
    """(replicate, dcr_5, nndr_5) over samples of ``share`` of both tables, drawn by hash; each sample is standardised by itself.

    Replicates are a column: a row names those that it is in, the neighbours of all are
    sought in one pass, and percentiles (linear between neighbours) come from one
    numbering within replicates.  A replicate without rows on either side has no row; nndr
    leaves out rows whose second distance is 0 or missing.
    """
    def drawn(df: DataFrame, side: str) -> DataFrame:
        reps = F.filter(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: uniform(f"{seed}|{side}", b, id_col) < share)
        return df.withColumn("reps", reps).where(F.size("reps") > 0)

    near = replicate_distances(drawn(real, "r"), drawn(fake, "f"), id_col, cols, replicates)
    cells = F.array(F.struct(F.lit("dcr").alias("what"), F.col("first").alias("v")), F.struct(F.lit("nndr").alias("what"), F.try_divide("first", "second").alias("v")))
    long = settled(near.select(F.col("rep").alias("replicate"), F.explode(cells).alias("x")).select("replicate", "x.*").where("v is not null"), "distances")
    placed = numbered_by_value(long, F.col("v"), ["replicate", "what"])
    sizes = long.groupBy("replicate", "what").agg(((F.count(F.lit(1)) - 1) * 0.05).alias("at"))
    after = F.col("pos") - 1 - F.floor("at")
    weight = F.when(after == 0, 1 - (F.col("at") - F.floor("at"))).when(after == 1, F.col("at") - F.floor("at"))
    fifth = placed.join(F.broadcast(sizes), ["replicate", "what"]).where(after.isin(0, 1)).groupBy("replicate", "what").agg(F.sum(weight * F.col("v")).alias("v"))  # two sizes a replicate
    return fifth.groupBy("replicate").agg(*[F.max(F.when(F.col("what") == w, F.col("v"))).alias(f"{w}_5") for w in ("dcr", "nndr")])


def privacy_distances(real: DataFrame, fake: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(pair, dcr_5, nndr_5) within real, within fake and across, after all copies of repeated rows went."""
    def once(df: DataFrame) -> DataFrame:
        own = single_rows(df.select(*cols))
        return df.join(own, cols, "left_semi")

    r, f = standardised(once(real), cols), standardised(once(fake), cols)
    runs = {"real_fake": (r, f, False), "real_real": (r, r, True), "fake_fake": (f, f, True)}
    parts = [fifth_percentiles(record_distances(a, b, id_col, cols, scale=False, exclude_self=s)).select(F.lit(k).alias("pair"), "dcr_5", "nndr_5") for k, (a, b, s) in runs.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


# --- G9, G10: attribution -----------------------------------------------------------------------------


def zero_cap(real: DataFrame, fake: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """1 - mean share of same-key synthetic rows with the real row's sensitive values (no such row counts 0)."""
    n_k = fake.groupBy(*keys).agg(F.count(F.lit(1)).alias("nk"))
    n_ks = fake.groupBy(*keys, *sensitive).agg(F.count(F.lit(1)).alias("nks"))
    groups = real.groupBy(*keys, *sensitive).agg(F.count(F.lit(1)).alias("w"))
    cap = groups.join(n_k, keys, "left").join(n_ks, [*keys, *sensitive], "left").withColumn("cap", F.coalesce(F.col("nks") / F.col("nk"), F.lit(0.0)))
    return cap.agg((1 - F.sum(F.col("cap") * F.col("w")) / F.sum("w")).alias("zero_cap"))


def generalised_cap(real: DataFrame, fake: DataFrame, keys: list[str], sensitive: list[str]) -> DataFrame:
    """As G9, but over the synthetic rows whose keys differ in the fewest columns.

    The sets of key columns form a lattice: grouping sets over the synthetic table count
    its rows for every set at once, the real groups name their values in every set, and
    both meet by (set, values).  The least level at which a real group met anything counts.
    A set that leaves out all keys meets everything, so each group has a level.  For up to
    ten key columns or so: the lattice has 2^keys sets.
    """
    text = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in [*keys, *sensitive]])
    r, f = text(real), text(fake)
    n = len(keys)
    chosen = [[c for i, c in enumerate(keys) if not gone >> (n - 1 - i) & 1] for gone in range(1 << n)]
    # bit by bit, from the first key on, gid tells which keys are left out
    lattice = f.groupingSets([[*map(F.col, some), *map(F.col, sensitive)] for some in chosen], *keys, *sensitive).agg(F.count(F.lit(1)).alias("nks"), F.grouping_id().alias("gid"))
    lattice = lattice.select(F.shiftright("gid", len(sensitive)).alias("gid"), *keys, *sensitive, "nks")
    by_key = lattice.groupBy("gid", *keys).agg(F.sum("nks").alias("nk"))
    groups = r.groupBy(*keys, *sensitive).agg(F.count(F.lit(1)).alias("w"))
    left_out = lambda i: F.shiftright("gid", n - 1 - i).bitwiseAND(1) == 1
    wanted = groups.withColumn("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << n) - 1).cast("long"))))
    wanted = wanted.select("gid", *[F.when(~left_out(i), F.col(c)).alias(f"_{c}") for i, c in enumerate(keys)], *[F.col(c).alias(f"={c}") for c in keys], *sensitive, "w")
    same = lambda t: reduce(lambda a, b: a & b, [F.col(f"_{c}").eqNullSafe(t[c]) for c in keys], wanted["gid"] == t["gid"])
    met = wanted.join(by_key, same(by_key)).select(wanted["gid"], *[f"_{c}" for c in keys], *[f"={c}" for c in keys], *sensitive, "w", "nk")
    hits = lattice.select(F.col("gid").alias("_gid"), *[F.col(c).alias(f"~{c}") for c in keys], *[F.col(c).alias(f"~{c}") for c in sensitive], "nks")
    on = reduce(lambda a, b: a & b, [F.col(f"_{c}").eqNullSafe(F.col(f"~{c}")) for c in keys] + [F.col(c) == F.col(f"~{c}") for c in sensitive], F.col("gid") == F.col("_gid"))
    both = met.join(hits, on, "left")
    level = F.bit_count("gid").alias("level")
    own = [f"={c}" for c in keys] + sensitive
    levels = both.groupBy(*own, level).agg(F.first("w").alias("w"), F.sum("nk").alias("nk"), F.sum(F.coalesce("nks", F.lit(0))).alias("nks"))
    least = levels.groupBy(*own).agg(F.min(F.struct("level", "w", "nk", "nks")).alias("x")).select("x.*")
    return least.agg((1 - F.sum(F.col("nks") / F.col("nk") * F.col("w")) / F.sum("w")).alias("generalised_cap"))


# --- G11-G15: attacks ---------------------------------------------------------------------------------

Z95 = 1.959963984540054


def wilson(success: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Centre and half width of Wilson's interval."""
    s, n = success.cast("double"), n.cast("double")
    denominator = n + z * z
    return F.try_divide(s + z * z / 2, denominator), z * F.sqrt(F.try_divide(s * (n - s), n) + z * z / 4) / denominator


def risk(rates: DataFrame) -> DataFrame:
    """Rates of attack, control and baseline (n, n_attack, n_control, n_baseline) to one row with the risk over the control."""
    parts = {k: wilson(F.col(f"n_{k}"), F.col("n")) for k in ("attack", "control", "baseline")}
    cols = [x for k, (c, h) in parts.items() for x in (c.alias(f"{k}_rate"), h.alias(f"{k}_error"))]
    a, c = parts["attack"][0], parts["control"][0]
    return rates.select("n", *cols, F.greatest(F.lit(0.0), F.try_divide(a - c, 1 - c)).alias("risk"))


def singling_out_univariate(real: DataFrame, fake: DataFrame, hold: DataFrame, discrete: list[str], continuous: list[str], seed: int = 42) -> DataFrame:
    """Predicates from fake (values that occur once; at or beyond its bounds) and how many single out one row.

    The baseline guesses are as many values drawn from fake's values by hash.
    """
    cols = [*discrete, *continuous]
    cells = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.*").where("value is not null")
    count = lambda df, n: cells(df).groupBy("col", "value").agg(F.count(F.lit(1)).alias(n))
    known = count(fake, "k")
    unique = known.where("k = 1").select("col", "value")
    hits = lambda preds, df, n: preds.join(count(df, "c"), ["col", "value"], "left").agg(F.count(F.lit(1)).alias(f"m_{n}"), F.count_if(F.col("c") == 1).alias(n))
    out = hits(unique, real, "a").crossJoin(hits(unique, hold, "c").select("c"))  # one row each
    total = unique.count()
    guesses = known.withColumn("_h", seeded(seed, "col", "value")).orderBy("_h").limit(total).select("col", "value")
    out = out.crossJoin(hits(guesses, real, "b").select("b"))
    ends = fake.agg(*[x for c in continuous for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if continuous else {}
    bound = lambda df: df.agg(*[x for c in continuous for x in (F.count_if(F.col(c) <= ends[f"lo_{c}"]).alias(f"lo_{c}"), F.count_if(F.col(c) >= ends[f"hi_{c}"]).alias(f"hi_{c}"))]).first()
    single = lambda row: sum(1 for v in row if v == 1) if continuous else 0
    more = [single(bound(df)) if continuous else 0 for df in (real, hold)]
    extra = 2 * len(continuous)
    rates = out.select((F.col("m_a") + extra).alias("n"), (F.col("a") + more[0]).alias("n_attack"), (F.col("c") + more[1]).alias("n_control"), F.col("b").alias("n_baseline"))
    return risk(rates)


def singling_out_multivariate(real: DataFrame, fake: DataFrame, hold: DataFrame, id_col: str, cols: list[str], n_cols: int = 2, attacks: int = 200, seed: int = 42) -> DataFrame:
    """Conjunctions of ``n_cols`` conditions taken from sampled synthetic rows; how many single out one row.

    A condition on a number is at least, or at most, its value, by the side of fake's
    median it lies on; on a category it is equality.  Nulls give no condition, and so does
    a number whose column has no median; nulls match none.  Predicates without a condition
    are none.  The stated predicates (``attacks`` of them) go to every task, which finds
    them through an index of their bounds.
    """
    types = dict(fake.dtypes)
    number = [c for c in cols if types[c] not in ("string", "boolean")]
    med = fake.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in number]).first() if number else {}
    use = [c for c in cols if c not in number or med[c] is not None]
    told = [F.col(c).cast("double" if c in number else "string").alias(c) for c in use]
    rows = fake.withColumn("_h", seeded(seed, id_col)).orderBy("_h").limit(attacks).select(F.col(id_col).alias("_id"), *told).collect()  # attacks rows
    known = lambda v: v is not None and v == v  # noqa: E731  not NaN
    preds = []
    for r in rows:
        rng = np.random.default_rng([seed, zlib.crc32(str(r["_id"]).encode())])
        preds.append([(c, ("<=" if r[c] <= med[c] else ">=") if c in number else "=", r[c]) for c in (use[i] for i in sorted(rng.permutation(len(use))[:n_cols])) if known(r[c])])
    guess = np.random.default_rng(seed)
    base = [[(c, str(guess.choice(["<=", ">="])) if c in number else "=", rows[int(guess.integers(len(rows)))][c]) for c in (use[i] for i in guess.permutation(len(use))[:n_cols])] for _ in rows]
    preds, base = [p for p in preds if p], [p for p in ([x for x in p if known(x[2])] for p in base) if p]
    one = lambda df, p, n: match_counts(df, p, use).agg(F.count_if(F.col("m") == 1).alias(n))
    rates = one(real, preds, "n_attack").crossJoin(one(hold, preds, "n_control")).crossJoin(one(real, base, "n_baseline"))  # one row each
    return risk(rates.withColumn("n", F.lit(len(preds)).cast("long")))


def gower_scaled(tables: list[DataFrame], cols: list[str], over: list[DataFrame]) -> list[DataFrame]:
    """Numeric columns to unit range over the union of ``over``."""
    both = reduce(lambda a, b: a.unionByName(b), [t.select(*cols) for t in over])
    one = both.agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    return [t.withColumns({c: (F.col(c).cast("double") - F.lit(float(one[f"lo_{c}"]))) / F.lit(float(one[f"hi_{c}"] - one[f"lo_{c}"]) or 1.0) for c in cols}) for t in tables]


def linkability(real: DataFrame, fake: DataFrame, hold: DataFrame, id_col: str, side_a: list[str], side_b: list[str], cats: list[str] = (), neighbours: tuple[int, ...] = tuple(range(4, 11)), seed: int = 42) -> DataFrame:
    """(n_neighbors, rates, risk): rows whose neighbours by both column sets share a synthetic row."""
    num = [c for c in [*side_a, *side_b] if c not in cats]
    r, h, f = gower_scaled([real, hold, fake], num, [real, fake])
    most = max(neighbours)

    def shared(df: DataFrame, guess: bool = False) -> DataFrame:
        near = []
        for name, cols in (("a", side_a), ("b", side_b)):
            top = knn_topk(df, f, id_col, id_col, [c for c in cols if c not in cats], most, [c for c in cols if c in cats], "gower")
            near.append(top.select(id_col, F.col("neighbour"), F.col("rank").alias(f"rank_{name}")))
        return near[0].join(near[1], [id_col, "neighbour"]).groupBy(id_col).agg(F.min(F.greatest("rank_a", "rank_b")).alias("least"))

    n, nf = real.count(), fake.count()
    a, c = shared(r), shared(h)
    nh = hold.count()
    parts = []
    for k in neighbours:
        # a guess links a row if two random sets of k synthetic rows meet
        miss = math.exp(sum(math.log1p(-k / (nf - i)) for i in range(k))) if nf > 2 * k else 0.0
        one = a.agg(F.count_if(F.col("least") <= k).alias("n_attack")).crossJoin(c.agg(F.round(F.count_if(F.col("least") <= k) * F.lit(n / max(1, nh))).cast("long").alias("n_control")))  # one row each
        parts.append(risk(one.withColumn("n", F.lit(n).cast("long")).withColumn("n_baseline", F.lit(round(n * (1 - miss))).cast("long"))).withColumn("n_neighbors", F.lit(k)))
    return reduce(lambda x, y: x.unionByName(y), parts)


def inference(real: DataFrame, fake: DataFrame, hold: DataFrame, id_col: str, keys: list[str], secret: str, cats: list[str] = (), tolerance: float = 0.05, seed: int = 42) -> DataFrame:
    """The nearest synthetic row by the key columns predicts the secret: rates and risk.

    Success is equality, or for a number a relative error within ``tolerance``.  The
    baseline takes a synthetic row by hash.
    """
    num = [c for c in keys if c not in cats]
    r, h, f = gower_scaled([real, hold, fake], num, [real, fake]) if num else (real, hold, fake)
    number = dict(real.dtypes)[secret] not in ("string", "boolean")

    def success(df: DataFrame, near: DataFrame, name: str) -> DataFrame:
        both = df.select(F.col(id_col).alias("_i"), F.col(secret).alias("_s")).join(near, F.col("_i") == near[id_col]).join(fake.select(F.col(id_col).alias("_n"), F.col(secret).alias("_p")), F.col("neighbour") == F.col("_n"))
        ok = F.abs(F.col("_p") - F.col("_s")) <= tolerance * F.abs(F.col("_s")) if number else F.col("_p").eqNullSafe(F.col("_s"))
        return both.agg(F.count_if(ok).alias(name))

    near = lambda df: knn_topk(df, f, id_col, id_col, num, 1, [c for c in keys if c in cats], "gower").select(id_col, "neighbour")
    places = numbered(fake.select(F.col(id_col).alias("neighbour")), seeded(seed, "neighbour"))
    nf, n, nh = fake.count(), real.count(), hold.count()
    drawn = real.select(id_col, (F.floor(uniform(seed, id_col) * nf) + 1).cast("long").alias("pos")).join(places, "pos").select(id_col, "neighbour")
    rates = success(real, near(r), "n_attack").crossJoin(success(hold, near(h), "c")).crossJoin(success(real, drawn, "n_baseline"))  # one row each
    return risk(rates.select(F.lit(n).cast("long").alias("n"), "n_attack", F.round(F.col("c") * F.lit(n / max(1, nh))).cast("long").alias("n_control"), "n_baseline"))


# --- G16, G17: density attack -------------------------------------------------------------------------


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): probability that a positive scores higher than a negative, ties half; by summed counts of equal scores.

    Scores are bucketed at approximate quantiles, so that no task sorts them all.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    cuts = sorted(set(counts.agg(F.percentile_approx("s", [k / 64 for k in range(1, 64)], 1000)).first()[0] or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("s"))) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("q").alias("tq"))
    below = totals.select("part", (F.sum("tq").over(Window.orderBy("part")) - F.col("tq")).alias("q0"))  # 64 rows
    inner = counts.withColumn("q1", F.sum("q").over(Window.partitionBy("part").orderBy("s")) - F.col("q")).join(F.broadcast(below), "part")
    return inner.agg(F.try_divide(F.sum(F.col("p") * (F.col("q0") + F.col("q1") + F.col("q") / 2.0)), F.sum("p") * F.sum("q").cast("double")).alias("auc"))


def density_attack(real: DataFrame, fake: DataFrame, hold: DataFrame, id_col: str, cols: list[str], mode: str = "prior") -> DataFrame:
    """(accuracy, auc) of telling members by density of synthetic data over a reference.

    Non-members are the first 70 % of the hold-out by id, the reference of mode kde the
    last 70 %.  Mode prior takes independent normals of the continuous columns (10 or more
    distinct values) of all real data.
    """
    size = hold.count()
    k = int(size * 0.7)
    placed = numbered_by_value(hold, F.col(id_col))
    test = real.select(id_col, *cols).withColumn("member", F.lit(1)).unionByName(placed.where(F.col("pos") <= k).select(id_col, *cols).withColumn("member", F.lit(0)))
    p_g = kde(test, fake, id_col, cols).withColumnRenamed("density", "p_g")
    if mode == "kde":
        p_r = kde(test, placed.where(F.col("pos") > size - k), id_col, cols).withColumnRenamed("density", "p_r")
    else:
        both = real.select(*cols).unionByName(hold.select(*cols))
        one = both.agg(*[x for c in cols for x in (F.count_distinct(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]).first()
        use = [c for c in cols if one[f"n_{c}"] >= 10]
        log = sum((-F.pow(F.col(c) - one[f"m_{c}"], 2) / (2 * one[f"v_{c}"]) - 0.5 * math.log(2 * math.pi * one[f"v_{c}"]) for c in use), F.lit(0.0))
        p_r = test.select(id_col, F.exp(log).alias("p_r"))
    rel = test.select(id_col, "member").join(p_g, id_col).join(p_r, id_col).withColumn("p_rel", F.col("p_g") / (F.col("p_r") + 1e-10))
    median = rel.agg(F.percentile_approx("p_rel", 0.5, 1_000_000).alias("med"))
    acc = rel.crossJoin(F.broadcast(median)).agg(F.avg(((F.col("p_rel") > F.col("med")).cast("int") == F.col("member")).cast("double")).alias("accuracy"))  # one row
    return acc.crossJoin(rank_auc(rel, "p_rel", "member"))  # one row each


# --- G18: accounting ----------------------------------------------------------------------------------

#: Renyi orders that the accounts are kept at (fixed values).
ORDERS = (*(1 + x / 10 for x in range(1, 100)), *range(12, 64))


def _log_moment(q: float, sigma: float, alpha: float) -> float:
    """log E[((1 - q) + q exp((2x - 1) / (2 sigma^2)))^alpha] for x normal with deviation sigma, any order above 1.

    The integrand is smooth and falls off like a normal density about a place between 0
    and alpha, so equal steps over that range sum to it beyond double precision.
    """
    x = np.linspace(-14 * sigma, alpha + 14 * sigma, 1 << 15)
    a, b = math.log1p(-q), math.log(q) + (2 * x - 1) / (2 * sigma * sigma)
    log = alpha * np.logaddexp(a, b) - x * x / (2 * sigma * sigma) - math.log(sigma * math.sqrt(2 * math.pi))
    top = log.max()
    return float(top + math.log(np.exp(log - top).sum() * (x[1] - x[0])))


def ledger_rdp(ledger: DataFrame, orders: tuple[float, ...] = ORDERS, group: str = "run") -> DataFrame:
    """(run, order, rdp) from ledger rows (run, q, noise, steps): Renyi privacy of each entry, added up."""
    def scan(batches):
        for batch in batches:
            q, s, n, o = (batch.column(i).to_pylist() for i in range(1, 5))
            rdp = [n_ * (0.0 if q_ == 0 else math.inf if s_ == 0 else o_ / (2 * s_ * s_) if q_ == 1 else _log_moment(q_, s_, o_) / (o_ - 1)) for q_, s_, n_, o_ in zip(q, s, n, o)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(rdp, pa.float64())], names=["run", "order", "rdp"])

    # equal entries are worked out once: steps add up first
    entries = ledger.groupBy(F.col(group).cast("string").alias("run"), F.col("q").cast("double").alias("q"), F.col("noise").cast("double").alias("noise")).agg(F.sum("steps").cast("long").alias("steps"))
    grid = entries.withColumn("order", F.explode(F.array(*[F.lit(float(o)) for o in orders])))
    return grid.select("run", "q", "noise", "steps", "order").mapInArrow(scan, "run string, order double, rdp double").groupBy("run", "order").agg(F.sum("rdp").alias("rdp"))


def ledger_epsilon(ledger: DataFrame, delta: float = 1e-5, orders: tuple[float, ...] = ORDERS, group: str = "run") -> DataFrame:
    """(run, epsilon, best_order): the least epsilon at ``delta`` over the orders."""
    eps = F.greatest(F.lit(0.0), F.col("rdp") - F.lit(math.log(delta)) / (F.col("order") - 1))
    return ledger_rdp(ledger, orders, group).withColumn("eps", eps).groupBy("run").agg(F.min("eps").alias("epsilon"), F.min_by("order", F.struct("eps", "order")).alias("best_order"))


def ledger_delta(ledger: DataFrame, epsilon: float, orders: tuple[float, ...] = ORDERS, group: str = "run") -> DataFrame:
    """(run, delta, log_delta, best_order): the least delta at ``epsilon`` over the orders, 1 at most."""
    log = F.least(F.lit(0.0), (F.col("order") - 1) * (F.col("rdp") - F.lit(epsilon)))
    best = ledger_rdp(ledger, orders, group).withColumn("log", log).groupBy("run").agg(F.min("log").alias("log_delta"), F.min_by("order", F.struct("log", "order")).alias("best_order"))
    return best.select("run", F.exp("log_delta").alias("delta"), "log_delta", "best_order")


def rates_card(rates: DataFrame, name: str, suffix: Column | str = "") -> DataFrame:
    """(metric, value): the risk of an attack, and by how much it beats the control and the guesses."""
    named = lambda kind: F.concat(F.lit(f"{name}_{kind}"), F.lit(suffix) if isinstance(suffix, str) else suffix).alias("metric")
    a, c, b = (F.col(f"{k}_rate") for k in ("attack", "control", "baseline"))
    cells = [F.struct(named(kind), value.alias("value")) for kind, value in (("risk", F.col("risk")), ("train_vs_control", a - c), ("train_vs_naive", a - b))]
    return rates.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def score_card(real: DataFrame, fake: DataFrame, hold: DataFrame, id_col: str, keys: list[str], sensitive: list[str], numeric: list[str], replicates: int = 100, attacks: int = 500) -> DataFrame:
    """(metric, value): a long table of the privacy metrics of one run, by names that H1 knows.

    Columns of ``numeric`` are clustered, and neighbours are sought in them; densities are
    taken over their two leading principal components.  DCR and NNDR are means over
    ``replicates`` samples.  Names that end in _exact are those of key classes (G5) instead
    of clusters, those in _full of whole tables instead of samples.
    """
    near = settled(dcr_nndr(real, fake, id_col, numeric), "near")
    boot = bootstrap_dcr_nndr(real, fake, id_col, numeric, replicates).agg(F.avg("dcr_5").alias("d"), F.avg("nndr_5").alias("n"))
    cells = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()])).alias("x")).select("x.*")
    axes = Pca(numeric, 1.0).fit(real)
    axes.axes = axes.axes[:2]
    low = [axes.transform(df.select(id_col, *numeric)) for df in (real, fake, hold)]
    half = len(numeric) // 2
    exact = {"k_anonymity": "dp_k_anonymization_synthetic_exact", "l_diversity": "dp_l_diversity_synthetic_exact", "k_map": "dp_k_map_exact", "delta_presence": "dp_delta_presence_exact"}
    name = reduce(lambda w, kv: w.when(F.col("metric") == kv[0], kv[1]), exact.items(), F.when(F.lit(False), ""))
    columns = [*keys, *numeric]
    own, other = Clusterings(real, numeric), Clusterings(fake, numeric)
    parts = [
        class_risk(real, fake, keys, sensitive).select(name.alias("metric"), F.col("fake").alias("value")),
        cells(k_anonymity(real, fake, numeric, fitted=(own, other)), {"dp_k_anonymization_synthetic": "fake", "dp_k_anonymization_safe": "safe"}),
        cells(l_diversity(real, fake, numeric, keys, fitted=(own, other)), {"dp_l_diversity_synthetic": "fake", "dp_l_diversity_safe": "safe"}),
        cells(k_map(real, fake, numeric, fitted=own), {"dp_k_map": "value"}),
        cells(delta_presence(real, fake, numeric, fitted=own), {"dp_delta_presence": "value"}),
        cells(re_identification(real, fake, id_col, numeric), {"dp_re_identification_score": "re_identification"}),
        cells(density_attack(*low, id_col, ["pc0", "pc1"][: len(axes.axes)]), {"dp_domias_mia_accuracy": "accuracy", "dp_domias_mia_auc": "auc"}),
        cells(zero_cap(real, fake, keys, sensitive), {"dp_categorical_zero_cap": "zero_cap"}),
        cells(generalised_cap(real, fake, keys, sensitive), {"dp_categorical_generalized_cap": "generalised_cap"}),
        cells(boot, {"dp_dcr_rf": "d", "dp_nndr_rf": "n"}),
        cells(near, {"dp_dcr_rf_full": "dcr_5", "dp_nndr_rf_full": "nndr_5"}),
        rates_card(singling_out_univariate(real, fake, hold, keys, numeric), "dp_single_out", "_1"),
        *[rates_card(singling_out_multivariate(real, fake, hold, id_col, columns, n, attacks), "dp_single_out", f"_{n}") for n in (2, 4, 8) if n <= len(columns)],
        *([linkability(real, fake, hold, id_col, numeric[:half], numeric[half:]).select(F.concat(F.lit("dp_linkability_"), "n_neighbors").alias("metric"), F.col("risk").alias("value"))] if half else []),
        *[cells(inference(real, fake, hold, id_col, numeric, s), {f"dp_inference_{s}": "risk"}) for s in sensitive],
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
