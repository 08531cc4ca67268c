"""Queries of section G: orders with their customers, lineitem and embeddings as real and synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.neighbours import kde
from ..operators import privacy as G
from .fixtures import ALL_COLS, DIMS, EMB, EMB_COLS, EMB_SQL, OC_FAKE, OC_REAL, halves, rounded, table, thirds, union_all, vectors
from .registry import register

KEYS, SENSITIVE = ["o_orderpriority", "c_mktsegment", "c_nationkey"], ["o_orderstatus"]
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("g01_k_anonymity")
def g01(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return G.k_anonymity(real, fake, _NUM)


@register("g02_l_diversity")
def g02(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return G.l_diversity(real, fake, _NUM, ["l_returnflag", "l_linenumber"])


@register("g03_k_map")
def g03(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return G.k_map(real, fake, _NUM)


@register("g04_delta_presence")
def g04(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return G.delta_presence(real, fake, _NUM)


_K = ", ".join(KEYS)
_CLASSES = (
    f"r AS (SELECT {_K}, COUNT(*) AS r, COUNT(DISTINCT o_orderstatus) AS rl FROM {OC_REAL} a GROUP BY ALL), f AS (SELECT {_K}, COUNT(*) AS f, COUNT(DISTINCT o_orderstatus) AS fl FROM {OC_FAKE} b GROUP BY ALL), "
    f"j AS (SELECT * FROM r FULL JOIN f USING ({_K}))"
)


@register(
    "g05_class_risk",
    f"WITH {_CLASSES} SELECT 'k_anonymity' AS metric, CAST(MIN(r) AS DOUBLE) AS real, CAST(MIN(f) AS DOUBLE) AS fake FROM j UNION ALL SELECT 'l_diversity', MIN(rl), MIN(fl) FROM j UNION ALL "
    "SELECT 'k_map', -1, MIN(CASE WHEN r IS NOT NULL THEN f END) FROM j UNION ALL SELECT 'delta_presence', -1, ROUND(MAX(CASE WHEN r IS NOT NULL THEN r / (COALESCE(f, 0) + 1e-8) END), 4) FROM j",
)
def g05(spark, sf):
    real, fake = halves(spark, sf)
    out = G.class_risk(real, fake, KEYS, SENSITIVE)
    return out.select("metric", F.coalesce("real", F.lit(-1.0)).alias("real"), F.round("fake", 4).alias("fake"))


_R, _F2 = f"(SELECT * FROM {EMB_SQL} e WHERE vec_id % 2 = 0)", f"(SELECT * FROM {EMB_SQL} e WHERE vec_id % 2 = 1)"


def _split(spark, sf, dims=EMB):
    v = vectors(spark, sf, dims)
    return v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")


def _ent(c: str) -> str:
    return f"(SELECT -SUM(p * LN(p)) + 1e-16 FROM (SELECT COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS p FROM {_R} r GROUP BY ROUND_EVEN({c} * 10, 0)) q)"


_W = "w AS (SELECT " + ", ".join(f"{_ent(c)} AS w{i}" for i, c in enumerate(EMB_COLS)) + ")"
_D6 = "SQRT(" + " + ".join(f"POWER(10 * (a.{c} - b.{c}) / w{i}, 2)" for i, c in enumerate(EMB_COLS)) + ")"


@register(
    "g06_re_identification",
    f"WITH {_W}, o AS (SELECT a.vec_id, MIN({_D6}) AS own FROM {_R} a, {_R} b, w WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id), h AS (SELECT a.vec_id, MIN({_D6}) AS hat FROM {_R} a, {_F2} b, w GROUP BY a.vec_id) "
    "SELECT ROUND(AVG(CASE WHEN hat < own THEN 1.0 ELSE 0.0 END), 6) AS re_identification FROM o JOIN h USING (vec_id)",
)
def g06(spark, sf):
    # scaled so that rounding leaves several values
    real, fake = (df.withColumns({c: F.col(c) * 10 for c in EMB_COLS}) for df in _split(spark, sf))
    return rounded(G.re_identification(real, fake, "vec_id", EMB_COLS), "re_identification")


def _std(src: str) -> str:
    cols = ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {c}" for c in EMB_COLS)
    return f"(SELECT vec_id, {cols} FROM {src} s)"


_D7 = "SQRT(" + " + ".join(f"POWER(a.{c} - b.{c}, 2)" for c in EMB_COLS) + ")"


def _near(a: str, b: str, self_: bool = False) -> str:
    where = " WHERE a.vec_id <> b.vec_id" if self_ else ""
    return f"(SELECT vec_id, MAX(CASE WHEN k = 1 THEN d END) AS dcr, MAX(CASE WHEN k = 1 THEN d END) / MAX(CASE WHEN k = 2 THEN d END) AS nndr FROM (SELECT a.vec_id, {_D7} AS d, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_D7}, b.vec_id) AS k FROM {a} a, {b} b{where}) n WHERE k <= 2 GROUP BY vec_id)"


@register("g07_dcr_nndr", f"SELECT ROUND(QUANTILE_CONT(dcr, 0.05), 6) AS dcr_5, ROUND(QUANTILE_CONT(nndr, 0.05), 6) AS nndr_5 FROM {_near(_std(_R), _std(_F2))} q")
def g07(spark, sf):
    real, fake = _split(spark, sf)
    return rounded(G.dcr_nndr(real, fake, "vec_id", EMB_COLS), "dcr_5", "nndr_5")


@register("g07_bootstrap")
def g07_bootstrap(spark, sf):
    real, fake = _split(spark, sf, DIMS)
    return G.bootstrap_dcr_nndr(real, fake, "vec_id", ALL_COLS)


_G8 = {"real_fake": _near(_std(_R), _std(_F2)), "real_real": _near(_std(_R), _std(_R), True), "fake_fake": _near(_std(_F2), _std(_F2), True)}


@register("g08_privacy_distances", union_all([f"SELECT '{k}' AS pair, ROUND(QUANTILE_CONT(dcr, 0.05), 6) AS dcr_5, ROUND(QUANTILE_CONT(nndr, 0.05), 6) AS nndr_5 FROM {q} q" for k, q in _G8.items()]))
def g08(spark, sf):
    real, fake = _split(spark, sf)
    return rounded(G.privacy_distances(real, fake, "vec_id", EMB_COLS), "dcr_5", "nndr_5")


_ZK = ["o_orderpriority", "c_mktsegment"]
_ZKS = ", ".join(_ZK)


@register(
    "g09_zero_cap",
    f"WITH f AS (SELECT {_ZKS}, o_orderstatus, c_nationkey % 5 AS n5, COUNT(*) AS nks FROM {OC_FAKE} b GROUP BY ALL), k AS (SELECT {_ZKS}, n5, SUM(nks) AS nk FROM f GROUP BY ALL) "
    f"SELECT ROUND(1 - AVG(COALESCE(CAST(f.nks AS DOUBLE) / k.nk, 0)), 6) AS zero_cap FROM (SELECT *, c_nationkey % 5 AS n5 FROM {OC_REAL} r) a LEFT JOIN k USING ({_ZKS}, n5) LEFT JOIN f USING ({_ZKS}, n5, o_orderstatus)",
)
def g09(spark, sf):
    real, fake = (df.withColumn("n5", F.col("c_nationkey") % 5) for df in halves(spark, sf))
    return rounded(G.zero_cap(real, fake, [*_ZK, "n5"], SENSITIVE), "zero_cap")


_GK = ["o_orderpriority", "c_mktsegment", "c_nationkey"]
_HAM = " + ".join(f"CASE WHEN a.{k} <> b.{k} THEN 1 ELSE 0 END" for k in _GK)


@register(
    "g10_generalised_cap",
    f"WITH a AS (SELECT {', '.join(_GK)}, o_orderstatus, COUNT(*) AS w FROM {OC_REAL} r GROUP BY ALL), b AS (SELECT {', '.join(_GK)}, o_orderstatus, COUNT(*) AS m FROM {OC_FAKE} f GROUP BY ALL), "
    f"d AS (SELECT a.*, b.m, {_HAM} AS h, CASE WHEN a.o_orderstatus = b.o_orderstatus THEN b.m ELSE 0 END AS hit FROM a, b), l AS (SELECT {', '.join(_GK)}, o_orderstatus, MIN(h) AS h FROM d GROUP BY ALL), "
    f"c AS (SELECT ANY_VALUE(w) AS w, SUM(hit) / SUM(m) AS cap FROM d JOIN l USING ({', '.join(_GK)}, o_orderstatus, h) GROUP BY {', '.join(_GK)}, o_orderstatus) SELECT ROUND(1 - SUM(cap * w) / SUM(w), 6) AS generalised_cap FROM c",
)
def g10(spark, sf):
    real, fake = halves(spark, sf)
    return rounded(G.generalised_cap(real, fake, _GK, SENSITIVE), "generalised_cap")


def _wilson(s: str) -> tuple[str, str]:
    z = "1.959963984540054"
    return f"(({s} + {z} * {z} / 2) / (n + {z} * {z}))", f"({z} * SQRT(CAST({s} AS DOUBLE) * (n - {s}) / n + {z} * {z} / 4) / (n + {z} * {z}))"


_A, _C = _wilson("n_attack")[0], _wilson("n_control")[0]
_RISK = "n, " + ", ".join(f"ROUND({_wilson('n_' + k)[i]}, 6) AS {k}_{m}" for k in ("attack", "control", "baseline") for i, m in enumerate(("rate", "error"))) + f", ROUND(GREATEST(0, ({_A} - {_C}) / (1 - {_C})), 6) AS risk"


def _rounded_risk(df):
    return rounded(df, *[c for c in df.columns if c not in ("n", "n_neighbors", "n_cols")])


_G11 = (
    "WITH o AS (SELECT o_orderkey % 4 AS k, CAST(ROUND(o_totalprice) AS BIGINT) AS cents, o_orderstatus, o_totalprice FROM orders), "
    "c AS (SELECT k, 'cents' AS col, CAST(cents AS VARCHAR) AS value FROM o UNION ALL SELECT k, 'o_orderstatus', o_orderstatus FROM o UNION ALL SELECT k, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM o), "
    "known AS (SELECT col, value, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY MD5('42|' || col || '|' || value)) AS pos FROM c WHERE k = 2 GROUP BY col, value), u AS (SELECT col, value FROM known WHERE n = 1), "
    "r AS (SELECT col, value, COUNT(*) AS c FROM c WHERE k < 2 GROUP BY ALL), h AS (SELECT col, value, COUNT(*) AS c FROM c WHERE k = 3 GROUP BY ALL), e AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM o WHERE k = 2), "
    "m AS (SELECT COUNT(*) FILTER (k < 2 AND o_totalprice <= lo) AS rl, COUNT(*) FILTER (k < 2 AND o_totalprice >= hi) AS rh, COUNT(*) FILTER (k = 3 AND o_totalprice <= lo) AS hl, COUNT(*) FILTER (k = 3 AND o_totalprice >= hi) AS hh FROM o, e), "
    "t AS (SELECT (SELECT COUNT(*) FROM u) + 2 AS n, (SELECT COUNT(*) FROM u JOIN r USING (col, value) WHERE c = 1) + CASE WHEN rl = 1 THEN 1 ELSE 0 END + CASE WHEN rh = 1 THEN 1 ELSE 0 END AS n_attack, "
    "(SELECT COUNT(*) FROM u JOIN h USING (col, value) WHERE c = 1) + CASE WHEN hl = 1 THEN 1 ELSE 0 END + CASE WHEN hh = 1 THEN 1 ELSE 0 END AS n_control, "
    "(SELECT COUNT(*) FROM known JOIN r USING (col, value) WHERE c = 1 AND pos <= (SELECT COUNT(*) FROM u)) AS n_baseline FROM m) "
    f"SELECT {_RISK} FROM t"
)


@register("g11_singling_out_univariate", _G11)
def g11(spark, sf):
    o = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice")).cast("long"))
    k = F.col("o_orderkey") % 4
    return _rounded_risk(G.singling_out_univariate(o.where(k < 2), o.where(k == 2), o.where(k == 3), ["cents", "o_orderstatus"], ["o_totalprice"]))


@register("g12_singling_out_multivariate")
def g12(spark, sf):
    real, fake, hold = thirds(spark, sf)
    one = lambda df: df.withColumn("row", F.xxhash64(*df.columns))
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber", "l_extendedprice", "l_linestatus", "l_suppkey"]
    parts = [G.singling_out_multivariate(one(real), one(fake), one(hold), "row", cols, n_cols=n, attacks=500).select(F.lit(n).alias("n_cols"), "*") for n in (2, 4, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RANGE = "x AS (SELECT " + ", ".join(f"MIN({c}) AS l{k}, NULLIF(MAX({c}) - MIN({c}), 0) AS w{k}" for k, c in enumerate(ALL_COLS)) + f" FROM {EMB_SQL} e WHERE vec_id % 4 < 3)"


def _gower(dims) -> str:
    return " + ".join(f"ABS((a.e{k} - l{k}) / COALESCE(w{k}, 1) - (b.e{k} - l{k}) / COALESCE(w{k}, 1))" for k in dims)


_Q = "q AS (SELECT *, vec_id % 4 AS part FROM " + EMB_SQL + " e)"
_G13 = (
    f"WITH {_RANGE}, {_Q}, d AS (SELECT a.vec_id, a.part, b.vec_id AS near, {_gower(range(32))} AS da, {_gower(range(32, 64))} AS db FROM q a, q b, x WHERE a.part <> 2 AND b.part = 2), "
    "k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY da, near) AS ra, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY db, near) AS rb FROM d), "
    "m AS (SELECT vec_id, part, MIN(GREATEST(ra, rb)) AS least FROM k WHERE ra <= 10 AND rb <= 10 GROUP BY ALL), s AS (SELECT COUNT(*) FILTER (part < 2) AS n, COUNT(*) FILTER (part = 2) AS nf, COUNT(*) FILTER (part = 3) AS nh FROM q), "
    "t AS (SELECT CAST(kk AS INTEGER) AS n_neighbors, n, (SELECT COUNT(*) FROM m WHERE part < 2 AND least <= kk) AS n_attack, CAST(ROUND((SELECT COUNT(*) FROM m WHERE part = 3 AND least <= kk) * (CAST(n AS DOUBLE) / nh)) AS BIGINT) AS n_control, "
    "CAST(ROUND(n * (1 - CASE WHEN nf > 2 * kk THEN EXP(LIST_SUM(LIST_TRANSFORM(RANGE(kk), lambda i: LN(1 - CAST(kk AS DOUBLE) / (nf - i))))) ELSE 0 END)) AS BIGINT) AS n_baseline FROM s, RANGE(4, 11) r(kk)) "
    f"SELECT n_neighbors, {_RISK} FROM t"
)
_G14 = (
    f"WITH {_RANGE}, {_Q}, d AS (SELECT a.vec_id, a.part, a.label AS mine, b.label AS theirs, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_gower(range(64))}, b.vec_id) AS k FROM q a, q b, x WHERE a.part <> 2 AND b.part = 2), "
    "f AS (SELECT label, ROW_NUMBER() OVER (ORDER BY MD5('42|' || CAST(vec_id AS VARCHAR))) AS pos FROM q WHERE part = 2), s AS (SELECT COUNT(*) FILTER (part < 2) AS n, COUNT(*) FILTER (part = 2) AS nf, COUNT(*) FILTER (part = 3) AS nh FROM q), "
    "g AS (SELECT COUNT(*) FILTER (q.label = f.label) AS hits FROM q, s JOIN f ON f.pos = CAST(FLOOR(CAST('0x' || SUBSTR(MD5('42|' || CAST(q.vec_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 * nf) AS BIGINT) + 1 WHERE q.part < 2), "
    "t AS (SELECT n, (SELECT COUNT(*) FROM d WHERE k = 1 AND part < 2 AND mine = theirs) AS n_attack, CAST(ROUND((SELECT COUNT(*) FROM d WHERE k = 1 AND part = 3 AND mine = theirs) * (CAST(n AS DOUBLE) / nh)) AS BIGINT) AS n_control, hits AS n_baseline FROM s, g) "
    f"SELECT {_RISK} FROM t"
)


@register("g13_linkability", _G13)
def g13(spark, sf):
    v = vectors(spark, sf, DIMS)
    k = F.col("vec_id") % 4
    out = G.linkability(v.where(k < 2), v.where(k == 2), v.where(k == 3), "vec_id", ALL_COLS[: DIMS // 2], ALL_COLS[DIMS // 2 :])
    return _rounded_risk(out)


@register("g14_inference", _G14)
def g14(spark, sf):
    v = vectors(spark, sf, DIMS)
    k = F.col("vec_id") % 4
    out = G.inference(v.where(k < 2), v.where(k == 2), v.where(k == 3), "vec_id", ALL_COLS, "label", tolerance=0.0)
    return _rounded_risk(out)


_G15 = "(SELECT COUNT(*) AS n, COUNT(*) FILTER (l_quantity > 25) AS n_attack, COUNT(*) FILTER (l_discount > 0.05) AS n_control, COUNT(*) FILTER (l_tax > 0.05) AS n_baseline FROM lineitem)"


@register("g15_risk", f"SELECT {_RISK} FROM {_G15} t")
def g15(spark, sf):
    li = table(spark, sf, "lineitem")
    rates = li.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_attack"), F.count_if(F.col("l_discount") > 0.05).alias("n_control"), F.count_if(F.col("l_tax") > 0.05).alias("n_baseline"))
    out = G.risk(rates)
    return rounded(out, *[c for c in out.columns if c != "n"])


_DC = ["p_size", "p_retailprice"]


def _quarters(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", *_DC)
    k = F.col("p_partkey") % 4
    return p.where(k < 2), p.where(k == 2), p.where(k == 3)


@register("g16_density_attack")
def g16(spark, sf):
    real, fake, hold = _quarters(spark, sf)
    return G.density_attack(real, fake, hold, "p_partkey", _DC)


@register("g17_density_attack_kde")
def g17(spark, sf):
    real, fake, hold = _quarters(spark, sf)
    return G.density_attack(real, fake, hold, "p_partkey", _DC, mode="kde")


_KP = "(SELECT p_partkey, p_size AS e0, p_retailprice AS e1 FROM part WHERE p_partkey % 4 < 2)"
_KS = "(SELECT p_partkey, p_size AS e0, p_retailprice AS e1 FROM part WHERE p_partkey % 4 = 2)"


@register(
    "g16_kernel_density",
    f"WITH c AS (SELECT COUNT(*) AS n, POWER(COUNT(*), -2.0 / 6) AS f, VAR_SAMP(e0) AS a, COVAR_SAMP(e0, e1) AS b, VAR_SAMP(e1) AS d FROM {_KS} s), i AS (SELECT n, a * f AS a, b * f AS b, d * f AS d, (a * d - b * b) * f * f AS det FROM c) "
    f"SELECT p.p_partkey, ROUND(1e6 * SUM(EXP(-0.5 * (d * POWER(p.e0 - s.e0, 2) - 2 * b * (p.e0 - s.e0) * (p.e1 - s.e1) + a * POWER(p.e1 - s.e1, 2)) / det)) / (ANY_VALUE(n) * 2 * PI() * SQRT(ANY_VALUE(det))), 4) AS density FROM {_KP} p, {_KS} s, i GROUP BY p.p_partkey",
)
def g16_density(spark, sf):
    real, fake, _ = _quarters(spark, sf)
    return rounded(kde(real, fake, "p_partkey", _DC).withColumn("density", 1e6 * F.col("density")), "density", digits=4)


@register("g18_ledger_epsilon")
def g18(spark, sf):
    o = table(spark, sf, "orders")
    ledger = o.groupBy(F.col("o_orderpriority").alias("run"), (0.01 + (F.col("o_orderkey") % 5) * 0.002).alias("q"), (0.8 + (F.col("o_custkey") % 3) * 0.2).alias("noise")).agg((F.count(F.lit(1)) / 10).cast("long").alias("steps"))
    return G.ledger_epsilon(ledger)


@register("g18_ledger_delta", "WITH l AS (SELECT o_orderpriority AS run, 8.0 + o_custkey % 3 AS noise, COUNT(*) // 10 AS steps FROM orders GROUP BY ALL), g AS (SELECT run, o, SUM(steps * o / (2 * noise * noise)) AS rdp FROM l, (SELECT 1 + x / 10.0 AS o FROM RANGE(1, 100) r(x) UNION ALL SELECT o FROM RANGE(12, 64) r(o)) q GROUP BY run, o) SELECT run, ROUND(MIN(LEAST(0.0, (o - 1) * (rdp - 5.0))), 4) AS log_delta FROM g GROUP BY run")
def g18_delta(spark, sf):
    o = table(spark, sf, "orders")
    ledger = o.groupBy(F.col("o_orderpriority").alias("run"), (8.0 + F.col("o_custkey") % 3).alias("noise")).agg(F.floor(F.count(F.lit(1)) / 10).alias("steps")).withColumn("q", F.lit(1.0))
    return rounded(G.ledger_delta(ledger, 5.0).select("run", "log_delta"), "log_delta", digits=4)


@register("g18_ledger_full_batch", "WITH l AS (SELECT o_orderpriority AS run, 8.0 + o_custkey % 3 AS noise, COUNT(*) // 10 AS steps FROM orders GROUP BY ALL), g AS (SELECT run, o, SUM(steps * o / (2 * noise * noise)) AS rdp FROM l, (SELECT 1 + x / 10.0 AS o FROM RANGE(1, 100) r(x) UNION ALL SELECT o FROM RANGE(12, 64) r(o)) q GROUP BY run, o), e AS (SELECT run, o, GREATEST(0, rdp - LN(1e-5) / (o - 1)) AS eps FROM g) SELECT run, ROUND(MIN(eps), 4) AS epsilon, ROUND(ARG_MIN(o, ROW(eps, o)), 1) AS best_order FROM e GROUP BY run")
def g18_full(spark, sf):
    o = table(spark, sf, "orders")
    ledger = o.groupBy(F.col("o_orderpriority").alias("run"), (8.0 + F.col("o_custkey") % 3).alias("noise")).agg(F.floor(F.count(F.lit(1)) / 10).alias("steps")).withColumn("q", F.lit(1.0))
    return rounded(rounded(G.ledger_epsilon(ledger), "epsilon", digits=4), "best_order", digits=1)


@register("g19_score_card")
def g19(spark, sf):
    v = vectors(spark, sf, DIMS).withColumn("bucket", F.round(F.col("e0") * 4).cast("string"))
    k = F.col("vec_id") % 4
    return G.score_card(v.where(k < 2), v.where(k == 2), v.where(k == 3), "vec_id", ["bucket"], ["label"], ALL_COLS)
