"""Similarity cards of many runs at once.

Scoring run by run reads the real table once a run.  Here all synthetic outputs are one
table with a column that names their run; each measure is one pass over both tables, keyed
by run, and the real side is counted once.  What is kept grows with categories, distinct
numbers and pairs of columns, a row each for every run that has them, not with their product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import inf, long_form, pair_counts
from ..functions.gram import correlation, gram_rows
from ..functions.scratch import settled
from .fidelity import _v_of

#: The real table's rows under ``src``; a run's rows are named by ``f`` and its number or name.
REAL = "r"
#: Ranges that the values of a column are cut into before they are ordered.
PARTS = 64


def _both(real: DataFrame, fakes: DataFrame, run: str, cols: list[str], cast: str) -> DataFrame:
    pick = lambda df, src: df.select(src.alias("src"), *[F.col(c).cast(cast).alias(c) for c in cols])
    return pick(real, F.lit(REAL)).unionByName(pick(fakes, F.concat(F.lit("f"), F.col(run).cast("string"))))


def _sides(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(src, key, ``value``, mine): each run's rows beside the real table's of the same key."""
    own = df.where(F.col("src") == REAL).select(*key, F.col(value).alias("mine"))
    return df.where(F.col("src") != REAL).select("src", *key, value).join(own, key)


def _categories(both: DataFrame, cols: list[str]) -> DataFrame:
    """(src, kl, chi2, dwp) of the discrete columns, from one count of categories."""
    counts = settled(long_form(both, cols, ["src"]).groupBy("src", "col", "value").agg(F.count(F.lit(1)).alias("n")), "categories")
    sizes = counts.groupBy("src", "col").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("there"), F.count("value").alias("kinds"), F.count(F.lit(1)).alias("lines"))
    real = counts.where((F.col("src") == REAL) & F.col("value").isNotNull()).select("col", "value", F.col("n").alias("n_real"))
    fake = counts.where((F.col("src") != REAL) & F.col("value").isNotNull()).select("src", "col", "value", "n")
    r = sizes.where(F.col("src") == REAL).select("col", F.col("rows").alias("r_rows"), F.col("there").alias("r_there"), F.col("kinds").alias("r_kinds"), F.col("lines").alias("r_lines"))
    f = sizes.where(F.col("src") != REAL).drop("lines")
    per = f.join(F.broadcast(r), "col")  # a row a column
    met = fake.join(real, ["col", "value"]).join(per.select("src", "col", "rows", "there", "r_rows", "r_there"), ["src", "col"])
    share = lambda a, b: F.col(a).cast("double") / F.col(b)
    p, q = share("n_real", "r_there"), share("n", "there")
    sums = met.groupBy("src", "col").agg(
        F.count(F.lit(1)).alias("met"), F.sum("n").alias("met_fake"), F.sum("n_real").alias("met_real"), F.sum(p * F.ln(p / q)).alias("kl"),
        F.sum((p - q) * (p - q) / q).alias("chi2"), F.sum(F.abs(share("n_real", "r_rows") - share("n", "rows"))).alias("apart"),
    )
    all_ = per.join(sums, ["src", "col"], "left").fillna(0)
    lacks = F.col("r_kinds") > F.col("met")  # the run lacks a real category
    any_ = (F.col("r_kinds") > 0) | (F.col("kinds") > 0)
    rest = F.coalesce(F.try_divide((F.col("there") - F.col("met_fake")).cast("double"), F.col("there")), F.lit(0.0))
    kl, chi2 = F.when(any_, F.when(lacks, inf()).otherwise(F.col("kl"))), F.when(any_, F.when(lacks, inf()).otherwise(F.col("chi2") + rest))
    apart = F.col("apart") + F.coalesce(F.try_divide((F.col("r_there") - F.col("met_real")).cast("double"), F.col("r_rows")), F.lit(0.0))
    return all_.groupBy("src").agg(F.avg(kl).alias("kl_divergence_discrete"), F.avg(chi2).alias("chisquare_discrete"), (F.sum(apart) / F.sum("r_lines") / F.sqrt(F.lit(2.0))).alias("dwp_discrete"))


def _normal_fits(both: DataFrame, cols: list[str]) -> DataFrame:
    """(src, kl, dwp) of the continuous columns: normal fits over complete rows, and means over all."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    aggs = [f(F.when(whole, F.col(c)) if w else F.col(c)).alias(f"{n}_{c}") for c in cols for n, f, w in (("a", F.avg, False), ("m", F.avg, True), ("s", F.stddev_pop, True))]
    one = both.groupBy("src").agg(*aggs)
    per = one.select("src", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), *[F.col(f"{n}_{c}").alias(n) for n in "ams"]) for c in cols])).alias("x")).select("src", "x.*")
    per = settled(per, "moments")
    own = per.where(F.col("src") == REAL).select("col", F.col("a").alias("ra"), F.col("m").alias("rm"), F.col("s").alias("rs"))
    pair = per.where(F.col("src") != REAL).join(F.broadcast(own), "col")  # a row a column
    gap = F.col("rm") - F.col("m")
    kl = F.ln(F.try_divide("s", "rs")) + F.try_divide(F.col("rs") * F.col("rs") + gap * gap, 2 * F.col("s") * F.col("s")) - 0.5
    return pair.groupBy("src").agg(F.avg(kl).alias("kl_divergence_continuous"), F.avg(F.abs(F.col("ra") - F.col("a")) / F.sqrt(F.lit(2.0))).alias("dwp_continuous"))


def _largest_gaps(both: DataFrame, cols: list[str]) -> DataFrame:
    """(src, ks): mean over columns of the largest gap between a run's distribution and the real one.

    Between two values of a run its distribution stands still and the real one only grows, so
    the largest gap lies at a value of the run, there or just below it.  Each value needs
    the real share up to it and below it: sums over ranges first, then within ranges.
    """
    cells = long_form(both, cols, ["src"], "double").where("value is not null and not isnan(value)")
    counts = settled(cells.groupBy("col", "value", "src").agg(F.count(F.lit(1)).alias("n")), "values")
    bounds = {r["col"]: sorted(set(r["b"])) for r in counts.groupBy("col").agg(F.percentile_approx("value", [k / PARTS for k in range(1, PARTS)], 1000).alias("b")).collect()}  # PARTS numbers a column
    part: Column = F.lit(0)
    for c, b in bounds.items():
        part = F.when(F.col("col") == c, F.size(F.filter(F.lit(b), lambda x: x < F.col("value")))).otherwise(part)
    counts = counts.withColumn("part", part)
    mine, of_real = F.col("src") == REAL, F.when(F.col("src") == REAL, F.col("n")).otherwise(0)
    totals = counts.groupBy("col", "part", "src").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("col", "src").orderBy("part")
    whole = Window.partitionBy("col", "src")
    totals = totals.select("col", "part", "src", (F.sum("n").over(before) - F.col("n")).alias("c0"), F.sum("n").over(whole).alias("cn"))  # PARTS rows a column and run
    real_parts = counts.groupBy("col", "part").agg(F.sum(of_real).alias("n"))
    real_parts = real_parts.select("col", "part", (F.sum("n").over(Window.partitionBy("col").orderBy("part")) - F.col("n")).alias("r0"), F.sum("n").over(Window.partitionBy("col")).alias("rn"))
    real_run = F.sum(of_real).over(Window.partitionBy("col", "part").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    real_here = F.sum(of_real).over(Window.partitionBy("col", "part", "value"))
    own_run = F.sum("n").over(Window.partitionBy("col", "part", "src").orderBy("value"))
    at = counts.select("col", "part", "src", "n", real_run.alias("r"), real_here.alias("h"), own_run.alias("c")).where(~mine)
    at = at.join(totals, ["col", "part", "src"]).join(F.broadcast(real_parts), ["col", "part"])  # PARTS rows a column
    share = lambda x, n: F.try_divide(x.cast("double"), F.col(n).cast("double"))
    r, c = F.col("r") + F.col("r0"), F.col("c") + F.col("c0")
    gap = F.greatest(F.abs(share(r, "rn") - share(c, "cn")), F.abs(share(r - F.col("h"), "rn") - share(c - F.col("n"), "cn")))
    return at.groupBy("src", "col").agg(F.max(gap).alias("ks")).groupBy("src").agg(F.avg("ks").alias("kolmogorov_smirnov_continuous"))


def _pairs(discrete: DataFrame, numbers: DataFrame, cols: list[str], nums: list[str]) -> tuple[DataFrame, DataFrame]:
    """(src, cramer) and (src, pearson): mean absolute differences over the pairs of columns that have both values."""
    whole = discrete.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    v = settled(_v_of(settled(pair_counts(whole, cols, ["src"]), "pairs")), "associations") if len(cols) > 1 else None
    r = settled(gram_rows(numbers, nums, "src").where("i < j").select("src", "i", "j", correlation().alias("r")), "correlations")
    mean = lambda df, key, x: _sides(df, key, x).groupBy("src").agg(F.avg(F.abs(F.col(x) - F.col("mine"))).alias("d"))
    none = numbers.select("src", F.lit(None).cast("double").alias("d")).limit(0)
    return (mean(v, ["c1", "c2"], "v") if v is not None else none), mean(r, ["i", "j"], "r")


def score_cards(real: DataFrame, fakes: DataFrame, run: str, discrete: list[str], continuous: list[str]) -> DataFrame:
    """(run, metric, value): the similarity card of every run, by the names that H1 knows.

    Equal to ``fidelity.score_card`` of each run's rows.  Rows whose run is null belong to
    none.  A measure that a run has no value for (no pair of columns varies) is null.
    """
    fakes = fakes.where(F.col(run).isNotNull())
    words, numbers = _both(real, fakes, run, discrete, "string"), _both(real, fakes, run, continuous, "double")
    runs = settled(fakes.select(F.col(run).alias("run")).distinct().withColumn("src", F.concat(F.lit("f"), F.col("run").cast("string"))), "runs")
    cramer, pearson = _pairs(words, numbers, discrete, continuous)
    parts = [
        _categories(words, discrete), _normal_fits(numbers, continuous), _largest_gaps(numbers, continuous),
        cramer.withColumnRenamed("d", "cramer_discrete"), pearson.withColumnRenamed("d", "pearson_continuous"),
    ]
    wide = reduce(lambda a, b: a.join(b, "src", "left"), parts, runs)
    names = [c for c in wide.columns if c not in ("run", "src")]
    return wide.select("run", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("run", "x.*")
