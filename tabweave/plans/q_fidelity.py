"""Queries of section E: similarity of lineitem's real and fake part."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import fidelity as E
from ..operators import ranking as H
from .fixtures import CONT, DISC, FAKE, REAL, cells, counts, mean_sql, rounded, table, thirds, union_all
from .registry import register

KL = "CASE WHEN {p} = 0 THEN 0 ELSE {p} * LN({p} / {q}) END"


@register("e01_kl_discrete", f"WITH {counts(DISC)}, m AS (SELECT col, SUM({KL.format(p='p', q='q')}) AS kl FROM s GROUP BY col) {mean_sql('m', 'kl')}")
def e01(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.kl_discrete(real, fake, DISC), "kl")


def _moments(cols, f="AVG"):
    return ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in cols)


_E2 = union_all([f"SELECT '{c}' AS col, LN(f.s_{c} / r.s_{c}) + (r.s_{c} * r.s_{c} + (r.m_{c} - f.m_{c}) * (r.m_{c} - f.m_{c})) / (2 * f.s_{c} * f.s_{c}) - 0.5 AS kl FROM r, f" for c in CONT])


@register("e02_kl_continuous", f"WITH r AS (SELECT {_moments(CONT)} FROM {REAL}), f AS (SELECT {_moments(CONT)} FROM {FAKE}), m AS ({_E2}) {mean_sql('m', 'kl', 8)}")
def e02(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.kl_continuous(real, fake, CONT), "kl", digits=8)


@register("e03_chi_square", f"WITH {counts(DISC)}, m AS (SELECT col, SUM((p - q) * (p - q) / q) AS chi2 FROM s GROUP BY col) {mean_sql('m', 'chi2', 8)}")
def e03(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.chi_square(real, fake, DISC), "chi2", digits=8)


_CUM = (
    f"a AS ({cells(CONT, REAL, cast='DOUBLE')}), b AS ({cells(CONT, FAKE, cast='DOUBLE')}), "
    "u AS (SELECT col, value, 1 AS r, 0 AS f FROM a UNION ALL SELECT col, value, 0, 1 FROM b), "
    "k AS (SELECT col, value, SUM(r) AS r, SUM(f) AS f FROM u WHERE value IS NOT NULL GROUP BY col, value), "
    "c AS (SELECT col, value, r, CAST(SUM(r) OVER w AS DOUBLE) / SUM(r) OVER (PARTITION BY col) AS fr, CAST(SUM(f) OVER w AS DOUBLE) / SUM(f) OVER (PARTITION BY col) AS ff, "
    "LEAD(value) OVER w AS nx FROM k WINDOW w AS (PARTITION BY col ORDER BY value))"
)


@register("e04_kolmogorov_smirnov", f"WITH {_CUM}, m AS (SELECT col, MAX(ABS(fr - ff)) AS ks FROM c GROUP BY col) {mean_sql('m', 'ks')}")
def e04(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.kolmogorov_smirnov(real, fake, CONT), "ks")


def _v_sql(c1: str, c2: str, side: str, src: str) -> str:
    return (
        f"(WITH t AS (SELECT {c1} AS a, {c2} AS b, COUNT(*) AS n FROM {src} GROUP BY 1, 2), r AS (SELECT a, SUM(n) AS n FROM t GROUP BY a), c AS (SELECT b, SUM(n) AS n FROM t GROUP BY b) "
        f"SELECT SQRT(GREATEST(0, SUM(CAST(t.n AS DOUBLE) * t.n / (CAST(r.n AS DOUBLE) * c.n)) - 1) / ((SELECT LEAST((SELECT COUNT(*) FROM r), (SELECT COUNT(*) FROM c))) - 1)) FROM t JOIN r USING (a) JOIN c USING (b))"
    )


_E5 = union_all([f"SELECT '{a}' AS c1, '{b}' AS c2, {_v_sql(a, b, 'r', REAL)} AS v_real, {_v_sql(a, b, 'f', FAKE)} AS v_fake" for a, b in combinations(DISC, 2)])


@register("e05_cramers_v", f"SELECT c1, c2, ROUND(v_real, 6) AS v_real, ROUND(v_fake, 6) AS v_fake, ROUND(ABS(v_real - v_fake), 6) AS diff, FALSE AS ignored FROM ({_E5}) x")
def e05(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.cramers_v(real, fake, DISC), "v_real", "v_fake", "diff")


_E6 = union_all([f"SELECT '{a}' AS c1, '{b}' AS c2, (SELECT CORR({a}, {b}) FROM {REAL} z) AS r_real, (SELECT CORR({a}, {b}) FROM {FAKE} z) AS r_fake" for a, b in combinations(CONT, 2)])


@register("e06_pearson", f"SELECT c1, c2, ROUND(r_real, 6) AS r_real, ROUND(r_fake, 6) AS r_fake, ROUND(ABS(r_real - r_fake), 6) AS diff, FALSE AS ignored FROM ({_E6}) x")
def e06(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.pearson(real, fake, CONT), "r_real", "r_fake", "diff")


@register("e07_matrix_difference", f"SELECT ROUND(2 * SUM(ABS(r_real - r_fake)) / {len(CONT) ** 2}, 6) AS corr_diff FROM ({_E6}) x")
def e07(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.matrix_difference(real, fake, CONT), "corr_diff")


@register("e08_dimension_probability", f"WITH {counts(DISC, nulls=True)} SELECT col, value, ROUND(p, 6) AS p, ROUND(q, 6) AS q, ROUND(ABS(p - q) / SQRT(2), 6) AS distance FROM s WHERE n_real > 0")
def e08(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.dimension_probability(real, fake, DISC, points=True), "p", "q", "distance")


@register("e08_dwp_score", f"WITH {counts(DISC, nulls=True)} SELECT ROUND(AVG(ABS(p - q) / SQRT(2)), 6) AS dwp FROM s WHERE n_real > 0")
def e08_score(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.dimension_probability(real, fake, DISC), "dwp")


_E9 = union_all([f"SELECT '{c}' AS col, ABS((SELECT AVG({c}) FROM {REAL} z) - (SELECT AVG({c}) FROM {FAKE} z)) / SQRT(2) AS distance" for c in CONT])


@register("e09_dimension_mean", f"WITH m AS ({_E9}) {mean_sql('m', 'distance', 4)}")
def e09(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.dimension_mean(real, fake, CONT), "distance", digits=4)


def _rho(a, b, src):
    return f"(SELECT COVAR_POP({a}, {b}) / ((STDDEV_SAMP({a}) + 1e-5) * (STDDEV_SAMP({b}) + 1e-5)) FROM {src} z)"


_E10 = " + ".join(f"POWER({_rho(a, b, REAL)} - {_rho(a, b, FAKE)}, 2)" for a, b in combinations(CONT, 2))


@register("e10_correlation_discrepancy", f"SELECT ROUND(2 * ({_E10}) / {len(CONT) * (len(CONT) - 1)}, 10) AS corr_loss")
def e10(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.correlation_discrepancy(real, fake, CONT), "corr_loss", digits=10)


def _moment(r: int, c: str, src: str) -> str:
    if r == 1:
        return f"(SELECT AVG({c}) FROM {src} z)"
    if r == 2:
        return f"(SELECT VAR_SAMP({c}) FROM {src} z)"
    return f"(SELECT AVG(POWER(({c} - m) / (s + 1e-5), {r})) FROM {src} z, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM {src} y) o)"


_E11 = union_all(
    [f"SELECT {r} AS moment, ROUND(({' + '.join(f'POWER(1 - ({_moment(r, c, FAKE)} + 1e-5) / ({_moment(r, c, REAL)} + 1e-5), 2)' for c in CONT)}) / {len(CONT)} * (1.0 / {r}), 6) AS loss" for r in (1, 2, 4)]
)


@register("e11_moment_discrepancy", _E11)
def e11(spark, sf):
    real, fake, _ = thirds(spark, sf)
    # the third moments of these symmetric columns are near zero, where a ratio tells nothing
    return rounded(E.moment_discrepancy(real, fake, CONT), "loss").where("moment <> 3")


_M = "((p + q) / 2)"


@register("e12_jensen_shannon", f"WITH {counts(DISC)}, m AS (SELECT col, SQRT(GREATEST(0, SUM(({KL.format(p='p', q=_M)}) + ({KL.format(p='q', q=_M)})) / 2 / LN(2))) AS jsd FROM s GROUP BY col) {mean_sql('m', 'jsd')}")
def e12(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.jensen_shannon(real, fake, DISC), "jsd")


@register("e13_wasserstein", f"WITH {_CUM}, e AS (SELECT col, MAX(value) - MIN(value) AS w FROM c WHERE r > 0 GROUP BY col), m AS (SELECT c.col, SUM(ABS(fr - ff) * (nx - value)) / ANY_VALUE(w) AS wasserstein FROM c JOIN e ON c.col = e.col GROUP BY c.col) {mean_sql('m', 'wasserstein')}")
def e13(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.wasserstein(real, fake, CONT), "wasserstein")


def _eta(g: str, y: str, src: str) -> str:
    return f"(SELECT SQRT(SUM(n * POWER(m - mu, 2)) / (SUM(n * POWER(m - mu, 2)) + SUM(n * v))) FROM (SELECT COUNT(*) AS n, AVG({y}) AS m, VAR_POP({y}) AS v FROM {src} z GROUP BY {g}) g, (SELECT AVG({y}) AS mu FROM {src} y) o)"


_E14 = union_all(
    [f"SELECT c1, c2, 'nominal' AS kind, v_real AS a_real, v_fake AS a_fake FROM ({_E5}) x", f"SELECT c1, c2, 'numeric', r_real, r_fake FROM ({_E6}) x"]
    + [f"SELECT '{g}', '{y}', 'ratio', {_eta(g, y, REAL)}, {_eta(g, y, FAKE)}" for g in DISC for y in CONT]
)


@register("e14_associations", f"SELECT c1, c2, kind, ROUND(a_real, 6) AS a_real, ROUND(a_fake, 6) AS a_fake FROM ({_E14}) x")
def e14(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.associations(real, fake, DISC, CONT), "a_real", "a_fake")


@register("e14_association_distance", f"SELECT ROUND(SQRT(2 * SUM(POWER(COALESCE(a_real, 0) - COALESCE(a_fake, 0), 2))), 6) AS frobenius FROM ({_E14}) x")
def e14_distance(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.association_distance(E.associations(real, fake, DISC, CONT)), "frobenius")


def _orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.md5(F.concat_ws("|", F.lit("7"), F.col("o_orderkey").cast("string"))).alias("h"))
    return o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")


def _side(parity: int, name: str) -> str:
    return f"(SELECT ROW_NUMBER() OVER (ORDER BY MD5('7|' || CAST(o_orderkey AS VARCHAR))) AS pos, o_totalprice AS {name} FROM orders WHERE o_orderkey % 2 = {parity})"


@register(
    "e15_vector_kl",
    f"WITH e AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0), j AS (SELECT x, GREATEST(lo, LEAST(hi, y)) AS y FROM {_side(0, 'x')} a JOIN {_side(1, 'y')} b USING (pos), e), "
    "n AS (SELECT x / SUM(x) OVER () AS p, y / SUM(y) OVER () AS q FROM j) SELECT ROUND(SUM(CASE WHEN p = 0 THEN 0 ELSE p * LN(p / q) END), 6) AS vector_kl FROM n",
)
def e15(spark, sf):
    real, fake = _orders(spark, sf)
    return rounded(E.vector_kl(real, fake, "o_totalprice", "h"), "vector_kl")


@register("e16_category_union", f"WITH {counts(DISC)} SELECT col, value, n_real, n_fake FROM k")
def e16_union(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return E.category_counts(real, fake, DISC)


@register("e16_category_intersection", f"WITH {counts(DISC)} SELECT col, value, n_real, n_fake FROM k WHERE n_real > 0 AND n_fake > 0")
def e16_intersection(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return E.category_counts(real, fake, DISC, "intersection")


def _avg(sql: str, value: str) -> str:
    return f"SELECT AVG({value}) FROM ({sql}) avg_of"


_CARD = {
    "kl_divergence_discrete": f"(WITH {counts(DISC)}, m AS (SELECT col, SUM({KL.format(p='p', q='q')}) AS x FROM s GROUP BY col) SELECT AVG(x) FROM m)",
    "kl_divergence_continuous": f"(WITH r AS (SELECT {_moments(CONT)} FROM {REAL}), f AS (SELECT {_moments(CONT)} FROM {FAKE}), m AS ({_E2}) SELECT AVG(kl) FROM m)",
    "chisquare_discrete": f"(WITH {counts(DISC)}, m AS (SELECT col, SUM((p - q) * (p - q) / q) AS x FROM s GROUP BY col) SELECT AVG(x) FROM m)",
    "kolmogorov_smirnov_continuous": f"(WITH {_CUM}, m AS (SELECT col, MAX(ABS(fr - ff)) AS x FROM c GROUP BY col) SELECT AVG(x) FROM m)",
    "cramer_discrete": f"(SELECT AVG(ABS(v_real - v_fake)) FROM ({_E5}) x)",
    "pearson_continuous": f"(SELECT AVG(ABS(r_real - r_fake)) FROM ({_E6}) x)",
    "dwp_discrete": f"(WITH {counts(DISC, nulls=True)} SELECT AVG(ABS(p - q) / SQRT(2)) FROM s WHERE n_real > 0)",
    "dwp_continuous": f"(SELECT AVG(distance) FROM ({_E9}) x)",
}


@register("e17_score_card", union_all([f"SELECT '{k}' AS metric, ROUND({v}, 4) AS value" for k, v in _CARD.items()]))
def e17(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.score_card(real, fake, DISC, CONT), "value", digits=4)


RUNS = 3
_RUN = "(SELECT * FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7 AND l_suppkey % {n} = {k})"
_LOWER = "('kl_divergence_discrete', 'kl_divergence_continuous', 'chisquare_discrete', 'dwp_discrete', 'dwp_continuous')"
_CARDS = union_all([f"SELECT {k} AS tid, '{m}' AS metric, ROUND({v.replace(FAKE, _RUN.format(n=RUNS, k=k))}, 6) AS value" for k in range(RUNS) for m, v in _CARD.items()])


def _cards(real, fake):
    return C.score_cards(real, fake.withColumn("run", (F.col("l_suppkey") % RUNS).cast("int")), "run", DISC, CONT)


@register("e17_run_cards", f"SELECT tid AS run, metric, ROUND(value, 4) AS value FROM ({_CARDS}) c")
def e17_runs(spark, sf):
    """The cards of several runs, each measure in one pass over all of them."""
    real, fake, _ = thirds(spark, sf)
    return rounded(_cards(real, fake), "value", digits=4)


@register(
    "h03_card_losses",
    f"WITH card AS ({_CARDS}), o AS (SELECT tid, metric, CASE WHEN metric IN {_LOWER} THEN -value ELSE value END AS score FROM card), "
    "r AS (SELECT tid, RANK() OVER (PARTITION BY metric ORDER BY score) + (COUNT(*) OVER (PARTITION BY metric, score) - 1) / 2.0 AS rank FROM o) SELECT tid, ROUND(-AVG(rank), 6) AS loss FROM r GROUP BY tid",
)
def h03_cards(spark, sf):
    """Score cards of several runs, ranked: the way from a card to the loss of its trial."""
    real, fake, _ = thirds(spark, sf)
    cards = _cards(real, fake).select(F.col("run").alias("tid"), F.lit("success").alias("reason"), "metric", F.round("value", 6).alias("value"))
    return rounded(H.rank_losses(cards, evaluation="statistics"), "loss")


_EPOCHS = "(SELECT *, l_suppkey % 5 AS epoch FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7)"
_E18_CORR = " + ".join(f"ABS(COALESCE(CORR({a}, {b}), 0) - COALESCE((SELECT CORR({a}, {b}) FROM {REAL} z), 0))" for a, b in combinations(CONT, 2))
_E18 = (
    f"WITH c AS (SELECT epoch, 2 * ({_E18_CORR}) / {len(CONT) ** 2} AS corr_diff FROM {_EPOCHS} t GROUP BY epoch), "
    f"a AS ({cells(DISC, REAL)}), p AS (SELECT col, value, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY col) AS p FROM a GROUP BY col, value), "
    f"b AS ({cells(DISC, _EPOCHS, 'epoch')}), q AS (SELECT epoch, col, value, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY epoch, col) AS q FROM b GROUP BY epoch, col, value), "
    "d AS (SELECT e.epoch, AVG(ABS(p - COALESCE(q, 0)) / SQRT(2)) AS dwp FROM p CROSS JOIN (SELECT DISTINCT epoch FROM b) e LEFT JOIN q ON q.epoch = e.epoch AND q.col = p.col AND q.value = p.value GROUP BY e.epoch), "
    "t AS (SELECT epoch, corr_diff + 10 * dwp AS score FROM c JOIN d USING (epoch)) "
)


@register("e18_best_epoch", _E18 + "SELECT epoch, ROUND(score, 6) AS score FROM t ORDER BY t.score, epoch LIMIT 1")
def e18(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(E.best_epoch(E.epoch_scores(real, fake.withColumn("epoch", F.col("l_suppkey") % 5), "epoch", DISC, CONT)), "score")
