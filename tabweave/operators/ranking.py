"""Section H: ranking scored trials and comparing methods over many blocks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normal, special
from ..functions.order import uniform

#: Stand-in for values that are not finite (fixed value).
FILL = 1e10

#: Which way each metric is better (fixed values, keys and order): matched exactly, else by the first key that the metric contains.
DIRECTIONS = {
    "kl_divergence_discrete": "lower",
    "kl_divergence_continuous": "lower",
    "chisquare_discrete": "lower",
    "kolmogorov_smirnov_continuous": "higher",
    "cramer_discrete": "higher",
    "pearson_continuous": "higher",
    "dwp_discrete": "lower",
    "dwp_continuous": "lower",
    "mse": "lower",
    "mae": "lower",
    "dp_categorical_zero_cap": "higher",
    "dp_categorical_generalized_cap": "higher",
    "dp_dcr_rf": "higher",
    "dp_nndr_rf": "higher",
    "dp_single_out_": "lower",
    "dp_linkability_": "lower",
    "dp_inference_": "lower",
    "dp_k_anonymization_synthetic": "higher",
    "dp_k_anonymization_safe": "higher",
    "dp_l_diversity_synthetic": "higher",
    "dp_l_diversity_safe": "higher",
    "dp_k_map": "higher",
    "dp_delta_presence": "lower",
    "dp_re_identification_score": "lower",
    "dp_domias_mia_accuracy": "lower",
    "dp_domias_mia_auc": "lower",
}
#: How an evaluation looks its metrics up: by the whole name, by part of it too, or (utility) errors are lower and all else higher.
EVALUATIONS = ("statistics", "privacy", "utility")


def direction(metric: Column, table: dict[str, str] | None = None, evaluation: str = "privacy") -> Column:
    """H1: higher or lower; an error if the evaluation's lookup does not know the metric."""
    if evaluation not in EVALUATIONS:
        raise ValueError(f"evaluation must be one of {EVALUATIONS}")
    if evaluation == "utility":
        return F.when(metric.contains("mae") | metric.contains("mse"), "lower").otherwise("higher")
    table = table or DIRECTIONS
    way = reduce(lambda w, kv: w.when(metric == kv[0], kv[1]), table.items(), F.when(F.lit(False), ""))
    if evaluation == "privacy":
        way = reduce(lambda w, kv: w.when(metric.contains(kv[0]), kv[1]), table.items(), way)
    return way.when(metric.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("no direction is known for the metric "), metric)))


def oriented(scores: DataFrame, table: dict[str, str] | None = None, policy: str = "reference", fill: float = FILL, evaluation: str = "privacy") -> DataFrame:
    """H2: add ``score``: the value made higher-is-better, with what is not finite filled in.

    Policy reference: NaN, null and +Inf become +fill before the sign turns (so they are
    worst where lower is better, but best where higher is); -Inf becomes -fill or, where
    lower is better, +fill.  Policy worst: all of them become -fill.
    """
    v, low = F.col("value"), direction(F.col("metric"), table, evaluation) == "lower"
    gone, plus, minus = v.isNull() | F.isnan(v), v == float("inf"), v == float("-inf")
    if policy == "worst":
        score = F.when(gone | plus | minus, -fill).when(low, -v).otherwise(v)
    else:
        score = F.when(gone | plus, F.when(low, -fill).otherwise(fill)).when(minus, F.when(low, fill).otherwise(-fill)).when(low, -v).otherwise(v)
    return scores.withColumn("score", score)


def ranked(scores: DataFrame, group: list[str], value: str = "score", method: str = "average") -> DataFrame:
    """H3, H4: add ``rank``, ascending within ``group``: average, min, max, dense or ordinal (by tid) on ties."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    low = F.rank().over(w)
    by = {
        "average": low + (ties - 1) / 2.0, "min": low.cast("double"), "max": (low + ties - 1).cast("double"), "dense": F.dense_rank().over(w).cast("double"),
        "ordinal": F.row_number().over(Window.partitionBy(*group).orderBy(value, "tid")).cast("double"),
    }
    return scores.withColumn("rank", by[method])


def complete(scores: DataFrame, trials: DataFrame, keys: list[str], fill: float = FILL) -> DataFrame:
    """Every successful trial with every metric of its project; absent scores are +fill."""
    metrics = scores.select(*[k for k in keys if k != "tid"], "metric").distinct()
    grid = trials.join(metrics, [k for k in keys if k != "tid"]) if len(keys) > 1 else trials.crossJoin(F.broadcast(metrics))  # metrics are few
    return grid.join(scores, [*keys, "metric"], "left").withColumn("score", F.coalesce("score", F.lit(fill)))


def rank_losses(scores: DataFrame, keys: list[str] = ["tid"], table: dict[str, str] | None = None, evaluation: str = "privacy") -> DataFrame:  # noqa: B006
    """H3: loss of each trial: minus its mean rank over metrics; failed trials (reason not success) get +Inf.

    ``scores`` has keys (project columns and tid), reason, metric and value.
    """
    good = scores.where("reason = 'success'")
    done = complete(oriented(good, table, evaluation=evaluation).select(*keys, "metric", "score"), good.select(*keys).distinct(), keys)
    ranks = ranked(done, [*[k for k in keys if k != "tid"], "metric"]).groupBy(*keys).agg((-F.avg("rank")).alias("loss"))
    failed = scores.where("reason <> 'success'").select(*keys).distinct().withColumn("loss", F.lit(float("inf")))
    return ranks.unionByName(failed)


def standard_losses(scores: DataFrame, how: str = "mean", table: dict[str, str] | None = None, evaluation: str = "privacy") -> DataFrame:
    """H5: loss of each trial: minus the mean (or median) of its oriented metrics; failed trials get +Inf."""
    agg = F.avg("score") if how == "mean" else F.expr("percentile(score, 0.5)")  # a trial's metrics are few
    good = oriented(scores.where("reason = 'success'"), table, evaluation=evaluation).groupBy("tid").agg((-agg).alias("loss"))
    return good.unionByName(scores.where("reason <> 'success'").select("tid").distinct().withColumn("loss", F.lit(float("inf"))))


def filter_folds(scores: DataFrame) -> DataFrame:
    """H6: metrics ``fold_name`` of folds without gmean above 0 and precision below 1 become null.

    If no trial has a passing fold at all, everything is left as it is.
    """
    fold, name = F.split_part(F.col("metric"), F.lit("_"), F.lit(1)), F.regexp_replace("metric", "^[^_]*_", "")
    cells = scores.withColumn("fold", fold).withColumn("name", name)
    flags = cells.groupBy("tid", "fold").agg(((F.coalesce(F.max(F.when(F.col("name") == "gmean", F.col("value"))), F.lit(0.0)) > 0) & (F.coalesce(F.max(F.when(F.col("name") == "precision", F.col("value"))), F.lit(1.0)) < 1)).alias("ok"))
    some = flags.agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("some"))
    out = cells.join(flags, ["tid", "fold"]).crossJoin(F.broadcast(some))  # one row
    return out.withColumn("value", F.when(F.col("ok") | ~F.col("some"), F.col("value"))).select(*scores.columns)


def best_trials(losses: DataFrame, project: list[str] = ()) -> DataFrame:
    """H7: the trial of least loss (the first on ties) and the number of successful trials, per project."""
    aggs = [F.min_by("tid", F.struct("loss", "tid")).alias("best_tid"), F.min("loss").alias("loss"), F.count_if(F.col("loss") < float("inf")).alias("n_success")]
    return losses.groupBy(*project).agg(*aggs)


def compare_variants(scores: DataFrame, keys: list[str], variants: tuple[int, int] = (0, 2)) -> DataFrame:
    """H8: (keys, metric, a, b): each metric of the best trials of two loss variants side by side.

    ``scores`` has keys, variant, tid, loss, metric and value.
    """
    best = scores.select(*keys, "variant", "tid", "loss").distinct().groupBy(*keys, "variant").agg(F.min_by("tid", F.struct("loss", "tid")).alias("tid"))
    own = scores.join(best, [*keys, "variant", "tid"]).select(*keys, "variant", "metric", "value")
    side = lambda v, name: own.where(F.col("variant") == v).drop("variant").withColumnRenamed("value", name)
    return side(variants[0], "a").join(side(variants[1], "b"), [*keys, "metric"])


def select_comparisons(table: DataFrame, allowed: dict[str, list], drop_equal: bool = False) -> DataFrame:
    """H9: rows of a comparison table whose descriptors are all among the allowed ones; optionally without equal pairs."""
    for c, values in allowed.items():
        table = table.where(F.col(c).isin(*values))
    return table.where(~F.col("a").eqNullSafe(F.col("b"))) if drop_equal else table


def mean_ranks(table: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(method, r, n): mean rank over the blocks that have every method; rank 1 is least."""
    k = table.select(method).distinct().count()
    full = table.where(F.col(value).isNotNull()).groupBy(block).agg(F.count_distinct(method).alias("_k")).where(F.col("_k") == k).select(block)
    ranks = ranked(table.join(full, block), [block], value, "average") if "tid" in table.columns else ranked(table.join(full, block).withColumn("tid", F.col(method)), [block], value)
    return ranks.groupBy(F.col(method).alias("method")).agg(F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n"))


def friedman(table: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """(chi2, df, p_value, n_blocks), with tie correction."""
    k = table.select(method).distinct().count()
    full = table.where(F.col(value).isNotNull()).groupBy(block).agg(F.count_distinct(method).alias("_k")).where(F.col("_k") == k).select(block)
    cells = table.join(full, block)
    ties = cells.groupBy(block, value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    one = mean_ranks(table, block, method, value).agg(F.sum(F.pow(F.col("r") * F.col("n"), 2)).alias("ss"), F.max("n").alias("n")).crossJoin(ties).first()
    if one["n"] is None or k < 2:
        return table.sparkSession.createDataFrame([], "chi2 double, df int, p_value double, n_blocks long")
    n = one["n"]
    raw = 12 / (n * k * (k + 1)) * one["ss"] - 3 * n * (k + 1)
    chi2 = raw / (1 - one["ties"] / (n * (k**3 - k)))
    return table.sparkSession.createDataFrame([(float(chi2), k - 1, normal.chi2_tail(chi2, k - 1), n)], "chi2 double, df int, p_value double, n_blocks long")


#: Critical values of the studentised range over sqrt(2), for 2 to 50 methods (fixed values).
CRITICAL = {
    0.01: (2.576, 2.913, 3.113, 3.255, 3.364, 3.452, 3.526, 3.590, 3.646, 3.696, 3.741, 3.781, 3.818, 3.853, 3.884, 3.914, 3.941, 3.967, 3.992, 4.015, 4.037, 4.057, 4.077, 4.096, 4.114,
           4.132, 4.148, 4.164, 4.179, 4.194, 4.208, 4.222, 4.236, 4.249, 4.261, 4.273, 4.285, 4.296, 4.307, 4.318, 4.329, 4.339, 4.349, 4.359, 4.368, 4.378, 4.387, 4.395, 4.404),
    0.05: (1.960, 2.344, 2.569, 2.728, 2.850, 2.948, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544, 3.569, 3.593, 3.616, 3.637, 3.658, 3.678,
           3.696, 3.714, 3.732, 3.749, 3.765, 3.780, 3.795, 3.810, 3.824, 3.837, 3.850, 3.863, 3.876, 3.888, 3.899, 3.911, 3.922, 3.933, 3.943, 3.954, 3.964, 3.973, 3.983, 3.992),
    0.10: (1.645, 2.052, 2.291, 2.460, 2.589, 2.693, 2.780, 2.855, 2.920, 2.978, 3.030, 3.077, 3.120, 3.159, 3.196, 3.230, 3.261, 3.291, 3.319, 3.346, 3.371, 3.394, 3.417, 3.439, 3.459,
           3.479, 3.498, 3.516, 3.533, 3.550, 3.567, 3.582, 3.597, 3.612, 3.626, 3.640, 3.653, 3.666, 3.679, 3.691, 3.703, 3.714, 3.726, 3.737, 3.747, 3.758, 3.768, 3.778, 3.788),
}


def critical_value(k: int, alpha: float = 0.05) -> float:
    """From the table at 0.01, 0.05 and 0.10 for 2 to 50 methods; otherwise by bisection of the range distribution."""
    if alpha in CRITICAL and 2 <= k < 2 + len(CRITICAL[alpha]):
        return CRITICAL[alpha][k - 2]
    lo, hi = 0.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal.range_tail(mid * math.sqrt(2), k) > alpha else (lo, mid)
    return (lo + hi) / 2


def nemenyi(table: DataFrame, block: str, method: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(m1, m2, diff, cd, significant, direction, p_value) for every ordered pair of methods."""
    means = mean_ranks(table, block, method, value)
    rows = sorted((r["method"], r["r"], r["n"]) for r in means.collect())  # a row a method
    k = len(rows)
    out = []
    for m1, r1, n in rows:
        for m2, r2, _ in rows:
            if m1 != m2:
                se = math.sqrt(k * (k + 1) / (6 * n))
                diff, cd = r1 - r2, critical_value(k, alpha) * se
                p = 2 * (1 - float(normal.cdf(abs(diff) / se))) if k == 2 else normal.range_tail(math.sqrt(2) * abs(diff) / se, k)
                out.append((m1, m2, diff, cd, abs(diff) > cd, "+" if diff > 0 else "-", float(p)))
    kind = dict(means.dtypes)["method"]
    return table.sparkSession.createDataFrame(out, f"m1 {kind}, m2 {kind}, diff double, cd double, significant boolean, direction string, p_value double")


def symbols(pairs: DataFrame) -> DataFrame:
    """One row a method, one symbol an opponent (0 if not significant; tripled to p <= 0.01, doubled to p <= 0.05), and totals."""
    sign = F.when(~F.col("significant"), "0").when(F.col("p_value") <= 0.01, F.repeat("direction", F.lit(3))).when(F.col("p_value") <= 0.05, F.repeat("direction", F.lit(2))).otherwise(F.col("direction"))
    cells = pairs.withColumn("symbol", sign)
    opponents = [r[0] for r in cells.select("m2").distinct().orderBy("m2").collect()]
    wide = cells.groupBy("m1").pivot("m2", opponents).agg(F.first("symbol"))
    totals = cells.groupBy("m1").agg(*[F.count_if(F.col("symbol").startswith(s)).alias(n) for s, n in (("+", "n_plus"), ("0", "n_zero"), ("-", "n_minus"))])
    return wide.join(totals, "m1").withColumnRenamed("m1", "method")


def win_rate(table: DataFrame, by: list[str] = (), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(by, win_rate, se, n): mean rank of variant b against a, less 1, and its bootstrap standard error.

    ``table`` has oriented a and b.  A replicate draws as many rows as there are, with
    replacement.  Rows of equal outcome (win, tie, loss) are interchangeable, so a replicate
    is a multinomial draw of their counts: ties first, then wins among the rest, each a
    binomial that is inverted at a hashed uniform.  Its cost depends on groups and
    replicates, not on rows.
    """
    outcome = lambda cond, n: F.count_if(cond).alias(n)
    counts = table.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), outcome(F.col("b") > F.col("a"), "wins"), outcome(F.col("b") == F.col("a"), "ties"))
    rate = F.try_divide(F.col("wins") + F.col("ties") / 2.0, F.col("n"))
    if not replicates:
        return counts.select(*by, rate.alias("win_rate"), "n")
    reps = counts.where("n > 0").select(*by, "n", "wins", "ties", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = lambda what: uniform(f"{seed}|{what}", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], "rep").alias(f"u_{what}")
    drawn = reps.select(*by, "n", "wins", "ties", u("tie"), u("win"))
    means = drawn.mapInArrow(_multinomial_means(len(by)), T.StructType([*[counts.schema[c] for c in by], T.StructField("m", T.DoubleType())]))
    se = means.groupBy(*by).agg(F.stddev_pop("m").alias("se"))
    out = counts.select(*by, rate.alias("win_rate"), "n")
    if not by:
        return out.crossJoin(se)  # one row each
    key = lambda c: F.col(f"_{c}").eqNullSafe(F.col(c))
    return out.join(se.select(*[F.col(c).alias(f"_{c}") for c in by], "se"), reduce(lambda a, b: a & b, [key(c) for c in by])).drop(*[f"_{c}" for c in by])


def _multinomial_means(keys: int):
    """Arrow batches of (keys, n, wins, ties, u_tie, u_win) to (keys, mean rank less 1 of the draw)."""

    def told(batches):
        for batch in batches:
            n, wins, ties, u_tie, u_win = (batch.column(keys + i).to_numpy() for i in range(5))
            mean = np.empty(len(n))
            sets, of = np.unique(np.stack([n, wins, ties], 1), axis=0, return_inverse=True)
            for k, (total, won, tied) in enumerate(sets):
                rows = np.flatnonzero(of.reshape(-1) == k)
                t = special.binomial_quantile(u_tie[rows], int(total), tied / total)
                w = np.zeros(len(rows), np.int64)
                for drawn in np.unique(t):  # a few deviations' worth of counts
                    same = t == drawn
                    w[same] = special.binomial_quantile(u_win[rows[same]], int(total - drawn), won / (total - tied) if total > tied else 0.0)
                mean[rows] = (w + t / 2) / total
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(keys)], pa.array(mean)], names=[*batch.schema.names[:keys], "m"])

    return told
