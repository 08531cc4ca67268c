"""Queries of section H: events as trials, and suppliers as blocks of methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as H
from .fixtures import rounded, table
from .registry import register

#: the five kinds of events stand for metrics; two of them are better when lower
WAYS = {"click": "lower", "view": "higher", "purchase": "higher", "signup": "lower", "error": "lower", "logout": "lower", "login": "higher"}
_LOW = "(" + ", ".join(f"'{k}'" for k, v in WAYS.items() if v == "lower") + ")"
_S = (
    "(SELECT tid, reason, metric, CASE WHEN tid % 17 = 0 AND metric = 'click' THEN NULL ELSE value END AS value FROM "
    "(SELECT user_id AS tid, CASE WHEN user_id % 13 = 0 THEN 'failed' ELSE 'success' END AS reason, event_type AS metric, ROUND(AVG(value), 1) AS value FROM events GROUP BY user_id, event_type) a)"
)


def _scores(spark, sf):
    """Means to one digit.  A mean in the middle of two tenths falls to the side that its last bits say, so values are
    added in the order of the events, as the table holds them, and tenfold means are rounded, as the SQL does."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.sum("value").over(w).alias("running"), F.count("value").over(w).alias("seen"))
    last = F.max_by(F.struct("running", "seen"), F.struct("seen", "event_id"))
    s = e.groupBy(F.col("user_id").alias("tid"), F.col("event_type").alias("metric")).agg(last.alias("x"))
    s = s.select("tid", "metric", (F.round(F.try_divide(F.col("x.running"), F.col("x.seen")) * 10) / 10).alias("value"))
    s = s.withColumn("value", F.when(~((F.col("tid") % 17 == 0) & (F.col("metric") == "click")), F.col("value")))
    return s.select("tid", F.when(F.col("tid") % 13 == 0, "failed").otherwise("success").alias("reason"), "metric", "value")


_O = f"(SELECT tid, reason, metric, CASE WHEN value IS NULL THEN CASE WHEN metric IN {_LOW} THEN -1e10 ELSE 1e10 END WHEN metric IN {_LOW} THEN -value ELSE value END AS score FROM {_S} s)"


def _oriented(spark, sf):
    return H.oriented(_scores(spark, sf), WAYS)


#: the library's own table, as it is pinned: written out here once more, so that the SQL does not depend on it
_WAY_SQL = (
    "(VALUES (0, 'kl_divergence_discrete', 'lower'), (1, 'kl_divergence_continuous', 'lower'), (2, 'chisquare_discrete', 'lower'), (3, 'kolmogorov_smirnov_continuous', 'higher'), (4, 'cramer_discrete', 'higher'), "
    "(5, 'pearson_continuous', 'higher'), (6, 'dwp_discrete', 'lower'), (7, 'dwp_continuous', 'lower'), (8, 'mse', 'lower'), (9, 'mae', 'lower'), (10, 'dp_categorical_zero_cap', 'higher'), "
    "(11, 'dp_categorical_generalized_cap', 'higher'), (12, 'dp_dcr_rf', 'higher'), (13, 'dp_nndr_rf', 'higher'), (14, 'dp_single_out_', 'lower'), (15, 'dp_linkability_', 'lower'), (16, 'dp_inference_', 'lower'), "
    "(17, 'dp_k_anonymization_synthetic', 'higher'), (18, 'dp_k_anonymization_safe', 'higher'), (19, 'dp_l_diversity_synthetic', 'higher'), (20, 'dp_l_diversity_safe', 'higher'), (21, 'dp_k_map', 'higher'), "
    "(22, 'dp_delta_presence', 'lower'), (23, 'dp_re_identification_score', 'lower'), (24, 'dp_domias_mia_accuracy', 'lower'), (25, 'dp_domias_mia_auc', 'lower')) w(k, name, way)"
)
_NAMES = ["kl_divergence_discrete", "kl_divergence_continuous", "chisquare_discrete", "kolmogorov_smirnov_continuous", "cramer_discrete", "pearson_continuous", "dwp_discrete", "dwp_continuous", "mse", "mae", "dp_categorical_zero_cap",
          "dp_categorical_generalized_cap", "dp_dcr_rf", "dp_nndr_rf", "dp_single_out_", "dp_linkability_", "dp_inference_", "dp_k_anonymization_synthetic", "dp_k_anonymization_safe", "dp_l_diversity_synthetic", "dp_l_diversity_safe",
          "dp_k_map", "dp_delta_presence", "dp_re_identification_score", "dp_domias_mia_accuracy", "dp_domias_mia_auc"]


def _named(spark, sf):
    """Events whose metrics bear the names of the library's table, bare or with something around them."""
    e = table(spark, sf, "events")
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("user_id") % len(_NAMES)).cast("int"))
    return e.withColumn("metric", F.when(F.col("event_type") == "click", name).otherwise(F.concat("event_type", F.lit("_"), name, F.lit("4"))))


@register("h01_directions", f"SELECT DISTINCT CASE WHEN event_type = 'click' THEN name ELSE event_type || '_' || name || '4' END AS metric, way FROM events JOIN {_WAY_SQL} ON user_id % 26 = k")
def h01(spark, sf):
    return _named(spark, sf).select("metric").distinct().withColumn("way", H.direction(F.col("metric")))


@register("h02_own_table", f"SELECT event_id, CASE WHEN way = 'lower' THEN -value ELSE value END AS score FROM events JOIN {_WAY_SQL} ON user_id % 26 = k")
def h02_own(spark, sf):
    return H.oriented(_named(spark, sf)).select("event_id", "score")


@register("h02_oriented", f"SELECT tid, metric, score FROM {_O} o")
def h02(spark, sf):
    return _oriented(spark, sf).select("tid", "metric", "score")


_GRID = f"g AS (SELECT t.tid, m.metric, COALESCE(o.score, 1e10) AS score FROM (SELECT DISTINCT tid FROM {_S} s WHERE reason = 'success') t CROSS JOIN (SELECT DISTINCT metric FROM {_S} s WHERE reason = 'success') m LEFT JOIN {_O} o ON o.tid = t.tid AND o.metric = m.metric)"
_R = f"{_GRID}, r AS (SELECT tid, metric, score, RANK() OVER (PARTITION BY metric ORDER BY score) + (COUNT(*) OVER (PARTITION BY metric, score) - 1) / 2.0 AS rank FROM g)"
_LOSS = f"{_R}, l AS (SELECT tid, -AVG(rank) AS loss FROM r GROUP BY tid UNION ALL SELECT DISTINCT tid, CAST('inf' AS DOUBLE) FROM {_S} s WHERE reason <> 'success')"


def _losses(spark, sf):
    s = _scores(spark, sf)
    good = s.where("reason = 'success'")
    done = H.complete(H.oriented(good, WAYS).select("tid", "metric", "score"), good.select("tid").distinct(), ["tid"])
    ranks = H.ranked(done, ["metric"]).groupBy("tid").agg((-F.avg("rank")).alias("loss"))
    return ranks.unionByName(s.where("reason <> 'success'").select("tid").distinct().withColumn("loss", F.lit(float("inf"))))


@register("h03_rank_losses", f"WITH {_LOSS} SELECT tid, ROUND(loss, 6) AS loss FROM l WHERE loss < 1e30")
def h03(spark, sf):
    return rounded(_losses(spark, sf).where("loss < 1e30"), "loss")


_TIES = "(SELECT tid, metric, score FROM {o} o WHERE reason = 'success')"


@register(
    "h04_tie_rules",
    f"SELECT tid, metric, CAST(RANK() OVER w AS DOUBLE) AS r_min, CAST(RANK() OVER w + COUNT(*) OVER (PARTITION BY metric, score) - 1 AS DOUBLE) AS r_max, CAST(DENSE_RANK() OVER w AS DOUBLE) AS r_dense, CAST(ROW_NUMBER() OVER (PARTITION BY metric ORDER BY score, tid) AS DOUBLE) AS r_ordinal FROM {_TIES.format(o=_O)} t WINDOW w AS (PARTITION BY metric ORDER BY score)",
)
def h04(spark, sf):
    o = _oriented(spark, sf).where("reason = 'success'").select("tid", "metric", "score")
    for m in ("min", "max", "dense", "ordinal"):
        o = H.ranked(o, ["metric"], method=m).withColumnRenamed("rank", f"r_{m}")
    return o.drop("score")


@register("h05_mean_losses", f"SELECT tid, ROUND(-AVG(score), 6) AS loss FROM {_O} o WHERE reason = 'success' AND tid % 17 <> 0 GROUP BY tid")
def h05(spark, sf):
    s = _oriented(spark, sf).where("reason = 'success' and tid % 17 <> 0")
    return s.groupBy("tid").agg(F.round(-F.avg("score"), 6).alias("loss"))


@register("h05_median_losses", f"WITH s AS (SELECT tid, CASE WHEN value IS NULL THEN 1e10 ELSE value END AS score FROM {_S} s WHERE reason = 'success') SELECT tid, ROUND(-QUANTILE_CONT(score, 0.5), 6) AS loss FROM s GROUP BY tid")
def h05_median(spark, sf):
    named = _scores(spark, sf).withColumn("metric", F.concat(F.lit("acc_"), "metric"))
    return rounded(H.standard_losses(named, "median", evaluation="utility").where("loss < 1e30"), "loss")


_F = "(SELECT user_id AS tid, 'fold' || CAST(event_id % 3 AS VARCHAR) || '_' || CASE event_type WHEN 'click' THEN 'gmean' WHEN 'view' THEN 'precision' ELSE event_type END AS metric, AVG(value) / 100 AS value FROM events GROUP BY 1, 2)"


@register(
    "h06_filter_folds",
    f"WITH c AS (SELECT *, SPLIT_PART(metric, '_', 1) AS fold, REGEXP_REPLACE(metric, '^[^_]*_', '') AS name FROM {_F} f), k AS (SELECT tid, fold, COALESCE(MAX(CASE WHEN name = 'gmean' THEN value END), 0) > 0 AND COALESCE(MAX(CASE WHEN name = 'precision' THEN value END), 1) < 1 AS ok FROM c GROUP BY tid, fold) "
    "SELECT tid, metric, ROUND(COALESCE(CASE WHEN ok OR NOT (SELECT BOOL_OR(ok) FROM k) THEN value END, -1) + 1e-7, 3) AS value FROM c JOIN k USING (tid, fold)",
)
def h06(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "gmean").when(F.col("event_type") == "view", "precision").otherwise(F.col("event_type"))
    s = e.groupBy(F.col("user_id").alias("tid"), F.concat(F.lit("fold"), (F.col("event_id") % 3).cast("string"), F.lit("_"), name).alias("metric")).agg((F.avg("value") / 100).alias("value"))
    return H.filter_folds(s).withColumn("value", F.round(F.coalesce("value", F.lit(-1.0)) + 1e-7, 3))


@register("h07_best_trials", f"WITH {_LOSS} SELECT tid % 4 AS project, ARG_MIN(tid, ROW(loss, tid)) AS best_tid, ROUND(MIN(loss), 6) AS loss, COUNT(*) FILTER (loss < CAST('inf' AS DOUBLE)) AS n_success FROM l GROUP BY tid % 4")
def h07(spark, sf):
    return rounded(H.best_trials(_losses(spark, sf).withColumn("project", F.col("tid") % 4), ["project"]), "loss")


_V = "(SELECT l_suppkey % 20 AS dataset, l_linenumber % 3 AS model, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 2 END AS variant, l_suppkey AS tid, l_returnflag AS metric, AVG(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
_VL = f"(SELECT v.*, AVG(value) OVER (PARTITION BY dataset, model, variant, tid) AS loss FROM {_V} v)"
_BEST = f"b AS (SELECT dataset, model, variant, ARG_MIN(tid, ROW(loss, tid)) AS tid FROM {_VL} v GROUP BY ALL), o AS (SELECT v.* FROM {_VL} v JOIN b USING (dataset, model, variant, tid)), c AS (SELECT x.dataset, x.model, x.metric, x.value AS a, y.value AS b FROM o x JOIN o y ON x.dataset = y.dataset AND x.model = y.model AND x.metric = y.metric AND x.variant = 0 AND y.variant = 2)"


def _variants(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = [(F.col("l_suppkey") % 20).alias("dataset"), (F.col("l_linenumber") % 3).alias("model"), F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(2).alias("variant"), F.col("l_suppkey").alias("tid")]
    v = li.groupBy(*keys, F.col("l_returnflag").alias("metric")).agg(F.avg("l_extendedprice").alias("value"))
    loss = v.groupBy("dataset", "model", "variant", "tid").agg(F.round(F.avg("value"), 4).alias("loss"))
    return H.compare_variants(v.join(loss, ["dataset", "model", "variant", "tid"]), ["dataset", "model"])


@register("h08_compare_variants", f"WITH {_BEST} SELECT dataset, model, metric, ROUND(a, 4) AS a, ROUND(b, 4) AS b FROM c")
def h08(spark, sf):
    return rounded(_variants(spark, sf), "a", "b", digits=4)


@register("h09_select_comparisons", f"WITH {_BEST} SELECT dataset, model, metric, ROUND(a, 4) AS a, ROUND(b, 4) AS b FROM c WHERE dataset IN (1, 2, 3, 5, 8) AND model IN (0, 2) AND a IS DISTINCT FROM b")
def h09(spark, sf):
    return rounded(H.select_comparisons(_variants(spark, sf), {"dataset": [1, 2, 3, 5, 8], "model": [0, 2]}, drop_equal=True), "a", "b", digits=4)


_M = "(SELECT l_linenumber AS method, l_suppkey AS block, ROUND(AVG(l_extendedprice), 2) AS score FROM lineitem GROUP BY 1, 2)"
_FULL = f"t AS (SELECT m.* FROM {_M} m JOIN (SELECT block FROM {_M} x GROUP BY block HAVING COUNT(*) = (SELECT COUNT(DISTINCT l_linenumber) FROM lineitem)) f USING (block)), r AS (SELECT method, block, RANK() OVER (PARTITION BY block ORDER BY score) + (COUNT(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS rank FROM t), a AS (SELECT method, AVG(rank) AS r, COUNT(*) AS n FROM r GROUP BY method)"


def _methods(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("method"), F.col("l_suppkey").alias("block")).agg(F.round(F.avg("l_extendedprice"), 2).alias("score"))


@register("h10_friedman", f"WITH {_FULL}, k AS (SELECT COUNT(*) AS k, MAX(n) AS n, SUM(POWER(r * n, 2)) AS ss FROM a), s AS (SELECT SUM(POWER(c, 3) - c) AS ties FROM (SELECT COUNT(*) AS c FROM t GROUP BY block, score)) SELECT ROUND((12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (POWER(k, 3) - k))), 5) AS chi2, CAST(k - 1 AS INTEGER) AS df, n AS n_blocks FROM k, s")
def h10(spark, sf):
    return rounded(H.friedman(_methods(spark, sf), "block", "method", "score"), "chi2", digits=5).drop("p_value")


@register("h11_nemenyi", f"WITH {_FULL}, p AS (SELECT x.method AS m1, y.method AS m2, x.r - y.r AS diff, 2.948 * SQRT(7 * 8 / (6.0 * x.n)) AS cd FROM a x JOIN a y ON x.method <> y.method) SELECT m1, m2, ROUND(diff, 6) AS diff, ROUND(cd, 6) AS cd, ABS(diff) > cd AS significant, CASE WHEN diff > 0 THEN '+' ELSE '-' END AS direction FROM p")
def h11(spark, sf):
    return rounded(H.nemenyi(_methods(spark, sf), "block", "method", "score"), "diff", "cd").drop("p_value")


@register("h12_nemenyi_p_values")
def h12(spark, sf):
    return H.nemenyi(_methods(spark, sf), "block", "method", "score").select("m1", "m2", "p_value")


@register("h13_symbols")
def h13(spark, sf):
    return H.symbols(H.nemenyi(_methods(spark, sf), "block", "method", "score"))


_PAIRS = (
    "WITH k AS (SELECT l_linenumber AS m, COUNT(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT a.m AS m1, a.n > b.n AS up, ABS(a.n - b.n) * 10 > a.n AS significant, CASE WHEN (a.n + b.n) % 5 = 0 THEN 0.01 WHEN (a.n + b.n) % 5 < 3 THEN 0.04 ELSE 0.2 END AS p, b.m AS m2 FROM k a JOIN k b ON a.m <> b.m), "
    "s AS (SELECT m1, m2, CASE WHEN NOT significant THEN '0' WHEN p <= 0.01 THEN REPEAT(CASE WHEN up THEN '+' ELSE '-' END, 3) WHEN p <= 0.05 THEN REPEAT(CASE WHEN up THEN '+' ELSE '-' END, 2) WHEN up THEN '+' ELSE '-' END AS s FROM p) "
)


@register(
    "h13_symbols_of_pairs",
    _PAIRS + "SELECT m1 AS method, " + ", ".join(f"COALESCE(MAX(CASE WHEN m2 = {k} THEN s END), '') AS against_{k}" for k in range(1, 8))
    + ", COUNT(*) FILTER (s LIKE '+%') AS n_plus, COUNT(*) FILTER (s = '0') AS n_zero, COUNT(*) FILTER (s LIKE '-%') AS n_minus FROM s GROUP BY m1",
)
def h13_pairs(spark, sf):
    """Pairs of line numbers, compared by their rows; significance and p come from the counts."""
    k = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    a, b = k.select(F.col("l_linenumber").alias("m1"), F.col("n").alias("n1")), k.select(F.col("l_linenumber").alias("m2"), F.col("n").alias("n2"))
    both, rest = a.join(b, F.col("m1") != F.col("m2")), (F.col("n1") + F.col("n2")) % 5
    pairs = both.select("m1", "m2", (F.abs(F.col("n1") - F.col("n2")) * 10 > F.col("n1")).alias("significant"), F.when(F.col("n1") > F.col("n2"), "+").otherwise("-").alias("direction"), F.when(rest == 0, 0.01).when(rest < 3, 0.04).otherwise(0.2).alias("p_value"))
    out = H.symbols(pairs)
    return out.select("method", *[F.coalesce(F.col(str(k)), F.lit("")).alias(f"against_{k}") for k in range(1, 8)], "n_plus", "n_zero", "n_minus")


_W = f"WITH {_BEST} SELECT {{by}}ROUND(AVG(CASE WHEN b > a THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END), 6) AS win_rate, COUNT(*) AS n FROM c"


def _wins(spark, sf):
    return _variants(spark, sf).withColumn("id", F.concat_ws("|", "dataset", "model", "metric"))


@register("h14_win_rate", _W.format(by=""))
def h14(spark, sf):
    return rounded(H.win_rate(_wins(spark, sf), replicates=0), "win_rate")


@register("h14_win_rate_by_dataset", _W.format(by="dataset, ") + " GROUP BY dataset")
def h14_dataset(spark, sf):
    return rounded(H.win_rate(_wins(spark, sf), ["dataset"], replicates=0), "win_rate")


@register("h14_win_rate_by_method", _W.format(by="model, ") + " GROUP BY model")
def h14_method(spark, sf):
    return rounded(H.win_rate(_wins(spark, sf), ["model"], replicates=0), "win_rate")


_REPLICATES = 1000


def _uniform_sql(what: str) -> str:
    return f"(CAST('0x' || SUBSTR(MD5('42|{what}|' || CAST(rep AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _log_share(n: str, k: str, p: str) -> str:
    """log of the binomial share of k out of n, for p within (0, 1)."""
    return f"LGAMMA({n} + 1) - LGAMMA({k} + 1) - LGAMMA({n} - {k} + 1) + {k} * LN({p}) + ({n} - {k}) * LN(1 - {p})"


#: ties are drawn first, then wins among the rest: the least count whose summed shares reach the replicate's uniform
_BOOT = (
    ", s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (b > a) AS wins, COUNT(*) FILTER (b = a) AS ties FROM c), q AS (SELECT *, CAST(ties AS DOUBLE) / n AS pt, CASE WHEN n > ties THEN CAST(wins AS DOUBLE) / (n - ties) ELSE 0 END AS pw FROM s), "
    f"u AS (SELECT rep, {_uniform_sql('tie')} AS ut, {_uniform_sql('win')} AS uw FROM RANGE(1, {_REPLICATES + 1}) r(rep)), "
    f"tc AS (SELECT k, SUM(CASE WHEN pt <= 0 THEN CASE WHEN k = 0 THEN 1 ELSE 0 END WHEN pt >= 1 THEN CASE WHEN k = n THEN 1 ELSE 0 END ELSE EXP({_log_share('n', 'k', 'LEAST(GREATEST(pt, 1e-300), 1 - 1e-16)')}) END) OVER (ORDER BY k) AS cdf FROM q, RANGE(0, (SELECT n + 1 FROM q)) t(k)), "
    "td AS (SELECT rep, uw, COALESCE(MIN(k) FILTER (cdf >= ut), (SELECT n FROM q)) AS t FROM u, tc GROUP BY rep, uw), "
    "m1 AS (SELECT DISTINCT t, n - t AS rest FROM td, q), "
    f"wc AS (SELECT t, k, SUM(CASE WHEN pw <= 0 OR rest = 0 THEN CASE WHEN k = 0 THEN 1 ELSE 0 END WHEN pw >= 1 THEN CASE WHEN k = rest THEN 1 ELSE 0 END ELSE EXP({_log_share('rest', 'k', 'LEAST(GREATEST(pw, 1e-300), 1 - 1e-16)')}) END) OVER (PARTITION BY t ORDER BY k) AS cdf FROM (SELECT t, rest, UNNEST(RANGE(0, rest + 1)) AS k FROM m1) x, q), "
    "wd AS (SELECT rep, td.t, COALESCE(MIN(k) FILTER (cdf >= uw), MAX(k)) AS w FROM td JOIN wc ON wc.t = td.t GROUP BY rep, td.t), m AS (SELECT rep, (w + t / 2.0) / n AS m FROM wd, q)"
)


@register("h14_bootstrap_error", f"WITH {_BEST}{_BOOT} SELECT ROUND((SELECT AVG(CASE WHEN b > a THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END) FROM c), 6) AS win_rate, (SELECT COUNT(*) FROM c) AS n, ROUND((SELECT STDDEV_POP(m) FROM m), 6) AS se")
def h14_error(spark, sf):
    return rounded(H.win_rate(_wins(spark, sf), replicates=_REPLICATES), "win_rate", "se")
