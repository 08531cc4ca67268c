"""How alike a synthetic table and its real source are: divergences, distances, associations.

All functions take the real and the fake table and column names, and return small long
tables.  Nulls are left out unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import cumulative_counts, discrete_counts, inf, long_form, pair_counts, proportions, tagged, with_mean
from ..functions.gram import correlation, covariance, gram_rows


def _kl_term(p: Column, q: Column) -> Column:
    """p ln(p / q): nothing where p is 0, infinite where only q is."""
    return F.when(p == 0, 0.0).when(q == 0, inf()).otherwise(p * F.ln(p / F.when(q == 0, 1.0).otherwise(q)))


def category_counts(real: DataFrame, fake: DataFrame, cols: list[str], how: str = "union") -> DataFrame:
    """Counts of the categories that either table has (union), or both have (intersection)."""
    counts = discrete_counts(real, fake, cols)
    return counts if how == "union" else counts.where("n_real > 0 and n_fake > 0")


def kl_discrete(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """KL divergence (natural log) of each column, and the mean; infinite if fake lacks a real category."""
    per = proportions(discrete_counts(real, fake, cols)).groupBy("col").agg(F.sum(_kl_term(F.col("p"), F.col("q"))).alias("kl"))
    return with_mean(per, "kl")


def kl_continuous(real: DataFrame, fake: DataFrame, cols: list[str], normalise: bool = False, complete_rows: bool = True) -> DataFrame:
    """KL divergence of normal fits (population deviation); optionally after z-scores by the sample deviation."""
    both = tagged(real, fake, cols, "double")
    both = both.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])) if complete_rows else both
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop), ("z", F.stddev_samp))]
    one = both.groupBy("src").agg(*aggs)
    r, k = (one.where(F.col("src") == s).select([F.col(c).alias(f"{s}_{c}") for c in one.columns if c != "src"]) for s in ("real", "fake"))

    def kl(c: str) -> Column:
        def moments(s: str):
            m, d, z = (F.col(f"{s}_{x}_{c}") for x in "msz")
            return (F.lit(0.0), F.try_divide(d, z)) if normalise else (m, d)

        (m1, s1), (m2, s2) = moments("real"), moments("fake")
        return F.ln(F.try_divide(s2, s1)) + F.try_divide(s1 * s1 + (m1 - m2) * (m1 - m2), 2 * s2 * s2) - 0.5

    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), kl(c).alias("kl")) for c in cols])).alias("x")
    return with_mean(r.crossJoin(k).select(rows).select("x.*"), "kl")  # one row each


def chi_square(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """Sum (p - q)^2 / q of category shares; infinite if fake lacks a real category."""
    p, q = F.col("p"), F.col("q")
    term = F.when(q == 0, F.when(p == 0, 0.0).otherwise(inf())).otherwise((p - q) * (p - q) / F.when(q == 0, 1.0).otherwise(q))
    return with_mean(proportions(discrete_counts(real, fake, cols)).groupBy("col").agg(F.sum(term).alias("chi2")), "chi2")


def jensen_shannon(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """Jensen-Shannon distance, base 2."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    term = (_kl_term(p, m) + _kl_term(q, m)) / 2 / F.ln(F.lit(2.0))
    return with_mean(proportions(discrete_counts(real, fake, cols)).groupBy("col").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term))).alias("jsd")), "jsd")


def kolmogorov_smirnov(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """Two-sample D."""
    per = cumulative_counts(real, fake, cols).groupBy("col").agg(F.max(F.abs(F.col("f_real") - F.col("f_fake"))).alias("ks"))
    return with_mean(per, "ks")


def wasserstein(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """1-Wasserstein distance after scaling by the real column's range."""
    seen = F.when(F.col("n_real") > 0, F.col("value"))
    area = F.sum(F.abs(F.col("f_real") - F.col("f_fake")) * (F.col("next_value") - F.col("value")))
    per = cumulative_counts(real, fake, cols).groupBy("col").agg(area.alias("area"), (F.max(seen) - F.min(seen)).alias("range"))
    return with_mean(per.select("col", F.try_divide("area", "range").alias("wasserstein")), "wasserstein")


def _contingency(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    both = tagged(real, fake, cols, "string")
    return pair_counts(both.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])), cols, ["src"])


def _v_of(counts: DataFrame) -> DataFrame:
    """(src, c1, c2, v): Cramér's V without correction; null where a side has a single category."""
    key = ["src", "c1", "c2"]
    rows = counts.groupBy(*key, "v1").agg(F.sum("n").alias("r"))
    cols = counts.groupBy(*key, "v2").agg(F.sum("n").alias("c"))
    size = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    total = counts.groupBy(*key).agg(F.sum("n").alias("t"))
    ratio = counts.join(rows, [*key, "v1"]).join(cols, [*key, "v2"]).groupBy(*key).agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    out = ratio.join(total, key).join(size(rows, "nr"), key).join(size(cols, "nc"), key)
    k = F.least("nr", "nc") - 1
    return out.select(*key, F.when(k > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s") - 1) / k)).alias("v"))


def cramers_v(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """E5: V of every pair in both tables, the absolute difference, and whether the pair is ignored (no value)."""
    v = _v_of(_contingency(real, fake, cols))
    out = v.groupBy("c1", "c2").agg(F.max(F.when(F.col("src") == "real", F.col("v"))).alias("v_real"), F.max(F.when(F.col("src") == "fake", F.col("v"))).alias("v_fake"))
    return out.withColumn("diff", F.abs(F.col("v_real") - F.col("v_fake"))).withColumn("ignored", F.col("diff").isNull())


def mean_difference(pairs: DataFrame, name: str = "mean_diff") -> DataFrame:
    """Mean of ``diff`` over the pairs that have one, and how many do not."""
    return pairs.agg(F.avg("diff").alias(name), F.count_if("ignored").alias("n_ignored"))


def _correlations(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """(src, c1, c2, r) of every pair, from sums of products by partition."""
    names = F.array(*[F.lit(c) for c in cols])
    rows = gram_rows(tagged(real, fake, cols, "double"), cols, "src").where("i < j")
    return rows.select("src", F.get(names, F.col("i")).alias("c1"), F.get(names, F.col("j")).alias("c2"), correlation().alias("r"))


def pearson(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """R of every pair in both tables, and the absolute difference."""
    out = _correlations(real, fake, cols).groupBy("c1", "c2").agg(F.max(F.when(F.col("src") == "real", F.col("r"))).alias("r_real"), F.max(F.when(F.col("src") == "fake", F.col("r"))).alias("r_fake"))
    return out.withColumn("diff", F.abs(F.col("r_real") - F.col("r_fake"))).withColumn("ignored", F.col("diff").isNull())


def matrix_difference(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """Mean absolute difference of the whole correlation matrices (missing r counts as 0, diagonal included)."""
    d = len(cols)
    off = pearson(real, fake, cols).agg(F.sum(F.abs(F.coalesce("r_real", F.lit(0.0)) - F.coalesce("r_fake", F.lit(0.0)))).alias("s"))
    return off.select((2 * F.col("s") / (d * d)).alias("corr_diff"))


def dimension_probability(real: DataFrame, fake: DataFrame, cols: list[str], points: bool = False) -> DataFrame:
    """Mean distance of (p_real, p_fake) to the diagonal, over real's categories; or the points themselves.

    Shares are of all rows, nulls included; a null category of real adds a distance of 0.
    """
    counts = discrete_counts(real, fake, cols, nulls=True).withColumn("p", F.col("n_real") / F.sum("n_real").over(Window.partitionBy("col"))).withColumn("q", F.col("n_fake") / F.sum("n_fake").over(Window.partitionBy("col")))
    found = counts.where("n_real > 0").select("col", "value", *[F.when(F.col("value").isNull(), 0.0).otherwise(F.col(x)).alias(x) for x in ("p", "q")])
    found = found.withColumn("distance", F.abs(F.col("p") - F.col("q")) / F.sqrt(F.lit(2.0)))
    return found if points else found.agg(F.avg("distance").alias("dwp"))


def dimension_mean(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """Distance of (mean real, mean fake) to the diagonal, by column and mean."""
    cells = long_form(tagged(real, fake, cols, "double"), cols, ["src"], "double")
    per = cells.groupBy("col").agg(F.avg(F.when(F.col("src") == "real", F.col("value"))).alias("a"), F.avg(F.when(F.col("src") == "fake", F.col("value"))).alias("b"))
    return with_mean(per.select("col", (F.abs(F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("distance")), "distance")


EPSILON = 1e-5


def correlation_discrepancy(real: DataFrame, fake: DataFrame, cols: list[str], eps: float = EPSILON) -> DataFrame:
    """Mean squared difference of off-diagonal correlations, with covariance over N and stabilised sample deviations."""
    rows = gram_rows(tagged(real, fake, cols, "double"), cols, "src")
    own = rows.where("i = j").select("src", "i", F.sqrt(covariance()).alias("s"))
    off = rows.where("i < j").select("src", "i", "j", covariance("pop").alias("c"))
    off = off.join(own.withColumnRenamed("s", "s1"), ["src", "i"]).join(own.select("src", F.col("i").alias("j"), F.col("s").alias("s2")), ["src", "j"])
    rho = off.groupBy("i", "j").agg(*[F.max(F.when(F.col("src") == s, F.col("c") / ((F.col("s1") + eps) * (F.col("s2") + eps)))).alias(s) for s in ("real", "fake")])
    d = len(cols)
    return rho.agg((2 * F.sum((F.col("real") - F.col("fake")) * (F.col("real") - F.col("fake"))) / (d * (d - 1))).alias("corr_loss"))


def moment_discrepancy(real: DataFrame, fake: DataFrame, cols: list[str], orders: int = 4, alpha: float = 1.0, eps: float = EPSILON) -> DataFrame:
    """Sum over orders r of mean over columns of alpha / r (1 - (fake moment + eps) / (real moment + eps))^2.

    Order 1 is the mean, 2 the sample variance, higher ones are of stabilised z-scores.
    """
    both = tagged(real, fake, cols, "double")
    first = both.groupBy("src").agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = both.join(F.broadcast(first), "src")  # one row a side
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + eps)
    moments = joined.groupBy("src").agg(*[F.avg(c).alias(f"o1_{c}") for c in cols], *[F.var_samp(c).alias(f"o2_{c}") for c in cols], *[F.avg(F.pow(z(c), r)).alias(f"o{r}_{c}") for r in range(3, orders + 1) for c in cols])
    side = lambda s: moments.where(F.col("src") == s).select([F.col(c).alias(f"{s}_{c}") for c in moments.columns if c != "src"])
    term = lambda r, c: F.pow(1 - (F.col(f"fake_o{r}_{c}") + eps) / (F.col(f"real_o{r}_{c}") + eps), 2)
    per = [F.struct(F.lit(r).alias("moment"), (sum((term(r, c) for c in cols), F.lit(0.0)) / len(cols) * (alpha / r)).alias("loss")) for r in range(1, orders + 1)]
    return side("real").crossJoin(side("fake")).select(F.explode(F.array(*per)).alias("x")).select("x.*")  # one row each


def associations(real: DataFrame, fake: DataFrame, nominal: list[str], numeric: list[str]) -> DataFrame:
    """(c1, c2, kind, a_real, a_fake): V, correlation ratio, or r of every pair of columns."""
    v = cramers_v(real, fake, nominal).select("c1", "c2", F.lit("nominal").alias("kind"), F.col("v_real").alias("a_real"), F.col("v_fake").alias("a_fake"))
    r = pearson(real, fake, numeric).select("c1", "c2", F.lit("numeric").alias("kind"), F.col("r_real").alias("a_real"), F.col("r_fake").alias("a_fake"))
    both = tagged(real, fake, [*nominal, *numeric])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).cast("string").alias("g"), F.col(b).cast("double").alias("y")) for a in nominal for b in numeric])).alias("x")
    groups = both.select("src", cells).select("src", "x.*").where("g is not null and y is not null").groupBy("src", "c1", "c2", "g").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("s2"))
    key = ["src", "c1", "c2"]
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*key)) / F.sum("n").over(Window.partitionBy(*key))
    eta = groups.withColumn("mu", mean).groupBy(*key).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), 2)).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"))
    eta = eta.select(*key, F.sqrt(F.try_divide(F.col("between"), F.col("between") + F.col("within"))).alias("a"))
    e = eta.groupBy("c1", "c2").agg(F.max(F.when(F.col("src") == "real", F.col("a"))).alias("a_real"), F.max(F.when(F.col("src") == "fake", F.col("a"))).alias("a_fake")).select("c1", "c2", F.lit("ratio").alias("kind"), "a_real", "a_fake")
    return v.unionByName(e).unionByName(r)


def association_distance(pairs: DataFrame) -> DataFrame:
    """Frobenius norm of the difference of the symmetric association matrices (diagonals are equal)."""
    d = F.coalesce("a_real", F.lit(0.0)) - F.coalesce("a_fake", F.lit(0.0))
    return pairs.agg(F.sqrt(2 * F.sum(d * d)).alias("frobenius"))


def vector_kl(real: DataFrame, fake: DataFrame, col: str, order: str) -> DataFrame:
    """Entropy of the normalised columns taken as vectors, aligned by position in the order of ``order``.

    Fake is clipped to real's range first; rows beyond the shorter table are left out.
    """
    from ..functions.order import numbered

    ends = real.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    a = numbered(real.select(F.col(col).cast("double").alias("x"), order), F.col(order)).select("pos", "x")
    b = numbered(fake.crossJoin(F.broadcast(ends)).select(F.greatest("lo", F.least("hi", F.col(col).cast("double"))).alias("y"), order), F.col(order)).select("pos", "y")  # one row of ends
    both = a.join(b, "pos")
    total = both.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    return both.crossJoin(F.broadcast(total)).agg(F.sum(_kl_term(F.try_divide("x", "tx"), F.try_divide("y", "ty"))).alias("vector_kl"))  # one row of totals


def score_card(real: DataFrame, fake: DataFrame, discrete: list[str], continuous: list[str]) -> DataFrame:
    """All similarity scores as one long table (metric, value), by the names that H1 knows."""
    last = lambda df, v: df.where("col = '__mean__'").select(F.col(v).alias("value"))
    parts = {
        "kl_divergence_discrete": last(kl_discrete(real, fake, discrete), "kl"),
        "kl_divergence_continuous": last(kl_continuous(real, fake, continuous), "kl"),
        "chisquare_discrete": last(chi_square(real, fake, discrete), "chi2"),
        "kolmogorov_smirnov_continuous": last(kolmogorov_smirnov(real, fake, continuous), "ks"),
        "cramer_discrete": mean_difference(cramers_v(real, fake, discrete)).select(F.col("mean_diff").alias("value")),
        "pearson_continuous": mean_difference(pearson(real, fake, continuous)).select(F.col("mean_diff").alias("value")),
        "dwp_discrete": dimension_probability(real, fake, discrete).select(F.col("dwp").alias("value")),
        "dwp_continuous": last(dimension_mean(real, fake, continuous), "distance"),
    }
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("metric"), "value") for k, df in parts.items()])


def best_epoch(scores: DataFrame, weight: float = 10.0) -> DataFrame:
    """The epoch of least corr_diff + weight * dwp (the smaller epoch on ties)."""
    return scores.agg(F.min_by("epoch", F.struct(F.col("corr_diff") + weight * F.col("dwp"), F.col("epoch"))).alias("epoch"), F.min(F.col("corr_diff") + weight * F.col("dwp")).alias("score"))


def epoch_scores(real: DataFrame, fakes: DataFrame, epoch: str, discrete: list[str], continuous: list[str]) -> DataFrame:
    """(epoch, corr_diff, dwp) of many synthetic outputs in one pass each over real and all of them."""
    d = len(continuous)
    own = gram_rows(real, continuous).where("i < j").select("i", "j", correlation().alias("mine"))
    theirs = gram_rows(fakes, continuous, epoch).where("i < j").select(F.col(epoch).cast(fakes.schema[epoch].dataType).alias("epoch"), "i", "j", correlation().alias("r"))
    gap = F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("mine", F.lit(0.0)))
    corr = theirs.join(own, ["i", "j"]).groupBy("epoch").agg((2 * F.sum(gap) / (d * d)).alias("corr_diff"))
    p = long_form(real, discrete, []).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("col")))
    q = long_form(fakes, discrete, [epoch]).groupBy(epoch, "col", "value").agg(F.count(F.lit(1)).alias("m")).withColumn("q", F.col("m") / F.sum("m").over(Window.partitionBy(epoch, "col")))
    # real's categories at every epoch: both are small
    grid = p.select("col", "value", "p").crossJoin(fakes.select(F.col(epoch).alias("epoch")).distinct())
    dist = grid.join(q.select(F.col(epoch).alias("epoch"), "col", "value", "q"), ["epoch", "col", "value"], "left").groupBy("epoch").agg(F.avg(F.abs(F.col("p") - F.coalesce("q", F.lit(0.0))) / F.sqrt(F.lit(2.0))).alias("dwp"))
    return corr.join(dist, "epoch")
