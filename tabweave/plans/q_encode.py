"""Queries of section C: encoders over the given tables, forward and back."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import encode as C
from .fixtures import CONT, REAL, rounded, table, thirds, union_all
from .registry import register

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEY = ", ".join(_LINE)


def _li(spark, sf, *more):
    return table(spark, sf, "lineitem").select(*_LINE, *more)


@register("c01_clean_strings", "SELECT p_partkey, CASE LOWER(TRIM(' ' || p_brand || ' ')) WHEN 'brand#11' THEN 'brand#1' ELSE LOWER(TRIM(p_brand)) END AS p_brand, LOWER(TRIM(p_type)) AS p_type FROM part")
def c01(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("p_brand"), "p_type")
    return C.clean_strings(p, ["p_brand", "p_type"], fold={"brand#11": "brand#1"})


_Q = "CASE WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderstatus END"


def _with_marks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "?").when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("x"))


@register("c02_placeholders", f"SELECT o_orderkey, COALESCE(NULLIF(NULLIF(TRIM({_Q}), '?'), ''), 'empty') AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE -9999999 END AS x FROM orders")
def c02(spark, sf):
    return C.fill_by_kind(C.placeholders_to_null(_with_marks(spark, sf), ["s"]), ["x"], ["s"])


@register("c03_dates_to_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(DATE_DIFF('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) END AS day FROM orders")
def c03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown").alias("day"))
    return C.DateEncoder(["day"], ref="1992-01-01").transform(o)


@register("c03_days_to_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN STRFTIME(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def c03_back(spark, sf):
    return C.DateEncoder(["day"], ref="1992-01-01").inverse(c03(spark, sf))


_Q7 = "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END"
_F3 = "CASE WHEN l_partkey % 3 <> 0 THEN l_returnflag END"


def _holes(spark, sf):
    return _li(spark, sf, F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")).alias("f"))


@register("c04_missing_values", f"SELECT {_KEY}, COALESCE({_Q7}, (SELECT QUANTILE_DISC({_Q7}, 0.5) FROM lineitem)) AS q, COALESCE({_F3}, '-1') AS f, CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS q_missing FROM lineitem")
def c04(spark, sf):
    df = _holes(spark, sf)
    return C.MissingEncoder(["q"], ["f"]).fit(df).transform(df)


@register("c04_missing_round_trip", f"SELECT {_KEY}, {_Q7} AS q, {_F3} AS f FROM lineitem")
def c04_back(spark, sf):
    df = _holes(spark, sf)
    e = C.MissingEncoder(["q"], ["f"]).fit(df)
    return e.inverse(e.transform(df))


@register("c05_minus_one_to_null", "SELECT c_custkey, COALESCE(CAST(NULLIF(c_nationkey % 4 - 1, -1) AS VARCHAR), 'null') AS k, NULLIF(CAST(c_nationkey % 3 - 1 AS VARCHAR), '-1') AS t FROM customer")
def c05(spark, sf):
    c = table(spark, sf, "customer")
    return C.minus_one_to_null(c.select("c_custkey", (F.col("c_nationkey") % 4 - 1).alias("k"), (F.col("c_nationkey") % 3 - 1).cast("string").alias("t"))).withColumn("k", F.coalesce(F.col("k").cast("string"), F.lit("null")))


@register("c06_binary", f"SELECT {_KEY}, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS even FROM lineitem")
def c06(spark, sf):
    df = _li(spark, sf, "l_linestatus", F.when(F.col("l_suppkey") % 2 == 0, "Yes").otherwise("No").alias("even"))
    return C.BinaryEncoder(["l_linestatus", "even"], others="sorted").fit(df).transform(df)


@register("c06_binary_round_trip", f"SELECT {_KEY}, l_linestatus FROM lineitem")
def c06_back(spark, sf):
    df = _li(spark, sf, "l_linestatus")
    e = C.BinaryEncoder(["l_linestatus"], others="sorted").fit(df)
    return e.inverse(e.transform(df))


_GROUPS = {"c_mktsegment": "segment", "other": "segment", "c_name": "name"}
_C7 = "(SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'ZZZ' ELSE c_mktsegment END AS other, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS c_name FROM customer)"


def _customers(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k % 2 == 0, "ZZZ").otherwise(F.col("c_mktsegment")).alias("other"), F.when(k % 11 != 0, F.col("c_name")).alias("c_name"))


_V7 = f"WITH t AS {_C7}, v AS (SELECT 'segment' AS grp, c_mktsegment AS value FROM t UNION SELECT 'segment', other FROM t UNION SELECT 'name', c_name FROM t WHERE c_name IS NOT NULL), c AS (SELECT grp, value, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY value) - 1 AS code FROM v) "


@register("c07_vocabulary", _V7 + "SELECT grp, value, code FROM c")
def c07_vocabulary(spark, sf):
    return C.vocabulary(_customers(spark, sf), _GROUPS)


@register("c07_label_encode", _V7 + "SELECT c_custkey, a.code AS c_mktsegment, b.code AS other, n.code AS c_name FROM t LEFT JOIN c a ON a.grp = 'segment' AND a.value = c_mktsegment LEFT JOIN c b ON b.grp = 'segment' AND b.value = other LEFT JOIN c n ON n.grp = 'name' AND n.value = c_name WHERE c_name IS NOT NULL")
def c07(spark, sf):
    df = _customers(spark, sf)
    return C.label_encode(df, C.vocabulary(df, _GROUPS), _GROUPS).where("c_name is not null")


@register("c07_label_round_trip", f"SELECT * FROM {_C7} t")
def c07_back(spark, sf):
    df = _customers(spark, sf)
    v = C.vocabulary(df, _GROUPS)
    return C.label_decode(C.label_encode(df, v, _GROUPS), v, _GROUPS)


@register("c08_pseudonyms", f"WITH v AS (SELECT DISTINCT {_F3} AS value FROM lineitem WHERE {_F3} IS NOT NULL), c AS (SELECT value, ROW_NUMBER() OVER (ORDER BY value) - 1 AS code FROM v) SELECT COALESCE(code, -1) AS code, COUNT(*) AS n FROM lineitem LEFT JOIN c ON value = {_F3} GROUP BY 1")
def c08(spark, sf):
    df = _holes(spark, sf)
    return C.label_encode(df, C.vocabulary(df, {"f": "f"}), {"f": "f"}).groupBy(F.coalesce("f", F.lit(-1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("c09_intervals", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS lo, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS is_known FROM part")
def c09(spark, sf):
    p, s = table(spark, sf, "part"), F.col("p_size")
    text = F.concat(F.lit("("), s.cast("string"), F.lit(".0, "), (s + 10).cast("string"), F.lit("]"))
    return p.select("p_partkey", C.interval_start(text).alias("lo"), C.sentinel_flag(F.when(s % 5 == 0, -1).otherwise(s)).alias("is_known"))


_HOT = "ARRAY_TO_STRING([" + ", ".join(f"CASE WHEN {_F3} = '{v}' THEN 1 ELSE 0 END" for v in "ANR") + f", CASE WHEN {_F3} IS NULL THEN 1 ELSE 0 END], '')"


@register("c10_one_hot", f"SELECT {_KEY}, {_HOT} AS f FROM lineitem")
def c10(spark, sf):
    df = _holes(spark, sf).drop("q")
    return C.OneHot(["f"]).fit(df).transform(df).withColumn("f", F.array_join(F.transform("f", lambda x: x.cast("int").cast("string")), ""))


@register("c10_one_hot_round_trip", f"SELECT {_KEY}, {_F3} AS f FROM lineitem")
def c10_back(spark, sf):
    df = _holes(spark, sf).drop("q")
    e = C.OneHot(["f"]).fit(df)
    return e.inverse(e.transform(df))


@register("c11_bits", "SELECT p_partkey, ARRAY_TO_STRING([" + ", ".join(f"(p_size >> {i}) & 1" for i in range(6)) + "], '') AS bits, CAST(p_size AS BIGINT) AS back FROM part")
def c11(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", C.to_bits(F.col("p_size"), 6).alias("b"))
    return df.select("p_partkey", F.array_join(F.transform("b", lambda x: x.cast("string")), "").alias("bits"), C.from_bits(F.col("b")).alias("back"))


@register("c12_rank_gauss")
def c12(spark, sf):
    df = _li(spark, sf, *CONT)
    return C.RankGauss(CONT).fit(df).transform(df)


@register("c12_round_trip", f"SELECT {_KEY}, ROUND(l_quantity, 2) AS l_quantity, ROUND(l_discount, 2) AS l_discount, ROUND(l_tax, 2) AS l_tax FROM lineitem")
def c12_back(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = _li(spark, sf, *cols)
    e = C.RankGauss(cols).fit(df)
    return rounded(e.inverse(e.transform(df)), *cols, digits=2)


_SLOTS = {"l_returnflag": ("A", "N", "R"), "l_linestatus": ("F", "O")}


@register(
    "c13_mixed_preprocessor",
    f"SELECT {_KEY}, l_returnflag, l_linestatus, TRUE AS price_is_near, " + ", ".join("CONCAT_WS('', " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for v in vs) + f") AS {c}_slots" for c, vs in _SLOTS.items()) + " FROM lineitem",
)
def c13(spark, sf):
    df = _li(spark, sf, "l_extendedprice", "l_returnflag", "l_linestatus").withColumn("price", F.col("l_extendedprice"))
    e = C.MixedPreprocessor(["l_extendedprice"], list(_SLOTS)).fit(df)
    slots = e.transform(df).withColumns({f"{c}_slots": F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "") for c in _SLOTS})
    back = e.inverse(slots)
    # ranks between two reference quantiles are interpolated: back within half a per cent of the range
    return back.withColumn("price_is_near", F.abs(F.col("l_extendedprice") - F.col("price")) < 500).drop("price", "l_extendedprice")


@register("c14_pipeline_round_trip", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN STRFTIME(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 <> 0 THEN ROUND(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS even, o_orderstatus FROM orders")
def c14(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 2 == 0, "yes").otherwise("no").alias("even"), "o_orderstatus")
    steps = [C.DateEncoder(["day"]), C.MissingEncoder(["day", "price"], ["o_orderstatus"]), C.BinaryEncoder(["even"]), C.MinMax(["price", "day"]), C.OneHot(["o_orderstatus"])]
    fitted, encoded = C.Pipeline(steps, {"price": "continuous", "even": "discrete", "o_orderstatus": "discrete"}).fit_transform(df)
    return C.Pipeline.from_json(fitted.to_json()).inverse(encoded).withColumn("price", F.round("price", 2))


@register("c15_conform", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS note, COALESCE(CAST(o_shippriority AS VARCHAR), 'null') AS o_shippriority, o_orderstatus FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS o_shippriority FROM orders) t")
def c15(spark, sf):
    o = table(spark, sf, "orders")
    like = spark.createDataFrame([], "o_orderkey long, note string, o_shippriority int, o_orderstatus string")
    k = F.col("o_orderkey")
    return C.conform(o.withColumn("o_shippriority", F.when(k % 2 == 0, (k % 9).cast("string")).otherwise("none")), like).withColumn("o_shippriority", F.coalesce(F.col("o_shippriority").cast("string"), F.lit("null")))


@register("c16_pca")
def c16(spark, sf):
    df = _li(spark, sf, *CONT)
    return C.Pca(CONT, 0.99).fit(df).transform(df)


@register("c16_pca_round_trip", f"SELECT {_KEY}, " + ", ".join(f"ROUND({c}, 2) AS {c}" for c in CONT) + " FROM lineitem")
def c16_back(spark, sf):
    df = _li(spark, sf, *CONT)
    e = C.Pca(CONT, 1.0).fit(df)
    return rounded(e.inverse(e.transform(df)), *CONT, digits=2)


@register("c17_mode_normaliser")
def c17(spark, sf):
    df = _li(spark, sf, "l_extendedprice", "l_quantity").withColumn("row", F.concat_ws("|", *_LINE))
    return C.ModeNormaliser(["l_extendedprice", "l_quantity"], pick="draw", id_col="row").fit(df).transform(df).drop("row")


@register("c17_round_trip", f"SELECT {_KEY}, ROUND(l_extendedprice, 2) AS l_extendedprice, ROUND(l_quantity, 2) AS l_quantity FROM lineitem")
def c17_back(spark, sf):
    cols = ["l_extendedprice", "l_quantity"]
    df = _li(spark, sf, *cols)
    e = C.ModeNormaliser(cols).fit(df)
    return rounded(e.inverse(e.transform(df)), *cols, digits=2)


@register("c18_mixed_modes", f"SELECT {_KEY}, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE ROUND(l_extendedprice, 2) END AS x, l_orderkey % 3 = 0 AS is_special FROM lineitem")
def c18(spark, sf):
    df = _li(spark, sf, F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("x"))
    e = C.ModeNormaliser(["x"], special={"x": [0.0]}).fit(df)
    coded = e.transform(df).withColumn("is_special", F.col("x_mode") >= len(e.modes["x"][0]))
    return rounded(e.inverse(coded), "x", digits=2).select(*_LINE, "x", "is_special")


@register("c19_slot_order", "WITH u AS (SELECT l_linenumber AS mode, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT mode, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, mode) - 1 AS INTEGER) AS slot FROM u")
def c19(spark, sf):
    return C.slot_order(table(spark, sf, "lineitem"), "l_linenumber")


@register("c20_min_max", f"SELECT {_KEY}, ROUND(2 * (l_extendedprice - lo) / (hi - lo) - 1, 6) AS l_extendedprice FROM lineitem, (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem) e")
def c20(spark, sf):
    df = _li(spark, sf, "l_extendedprice")
    return rounded(C.MinMax(["l_extendedprice"]).fit(df).transform(df), "l_extendedprice")


_LOG = {"l_extendedprice": "LN(l_extendedprice)", "l_discount": "LN(l_discount + 1)", "shifted": "LN(l_quantity - 30 - (SELECT MIN(l_quantity) - 30 FROM lineitem) + 1)"}


@register("c21_log", f"SELECT {_KEY}, " + ", ".join(f"ROUND({e}, 6) AS {c}" for c, e in _LOG.items()) + " FROM lineitem")
def c21(spark, sf):
    df = _li(spark, sf, "l_extendedprice", "l_discount", (F.col("l_quantity") - 30).alias("shifted"))
    return rounded(C.LogTransform(list(_LOG)).fit(df).transform(df), *_LOG)


@register("c21_log_round_trip", f"SELECT {_KEY}, ROUND(l_extendedprice, 2) AS l_extendedprice, ROUND(l_quantity - 30, 2) AS shifted FROM lineitem")
def c21_back(spark, sf):
    df = _li(spark, sf, "l_extendedprice", (F.col("l_quantity") - 30).alias("shifted"))
    e = C.LogTransform(["l_extendedprice", "shifted"]).fit(df)
    return rounded(e.inverse(e.transform(df)), "l_extendedprice", "shifted", digits=2)


@register("c22_sentinels", f"SELECT o_orderkey, NULLIF(NULLIF(TRIM({_Q}), '?'), '') AS s, COALESCE(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(ROUND(o_totalprice) AS BIGINT) AS VARCHAR) END, 'null') AS x FROM orders")
def c22(spark, sf):
    return C.unfill_by_kind(c02(spark, sf), ["x"], ["s"], integers=("x",)).withColumn("x", F.coalesce(F.col("x").cast("string"), F.lit("null")))


_OUT = [f"{c} NOT BETWEEN (SELECT MIN({c}) FROM {REAL} r WHERE l_discount < 0.09) AND (SELECT MAX({c}) FROM {REAL} r WHERE l_discount < 0.09)" for c in ("l_extendedprice", "l_discount")]


@register("c23_reject_outside", f"SELECT COUNT(*) AS n, COUNT(*) FILTER ({' OR '.join(_OUT)}) AS n_rejected FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7")
def c23(spark, sf):
    real, fake, _ = thirds(spark, sf)
    fit = C.MinMax(["l_extendedprice", "l_discount"]).fit(real.where("l_discount < 0.09"))
    return C.reject_outside(fake, {c: tuple(b) for c, b in fit.bounds.items()})[1]


_SEEN = f"(SELECT DISTINCT l_quantity AS v FROM {REAL} r WHERE l_linenumber % 3 = 0 AND l_quantity % 5 = 0)"


@register("c24_snap", f"SELECT x, (SELECT v FROM {_SEEN} s ORDER BY ABS(v - x), v LIMIT 1) AS l_quantity, COUNT(*) AS n FROM (SELECT l_quantity + 0.25 AS x FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7) t GROUP BY x")
def c24(spark, sf):
    real, fake, _ = thirds(spark, sf)
    df = fake.select((F.col("l_quantity") + 0.25).alias("x"), (F.col("l_quantity") + 0.25).alias("l_quantity"))
    return C.snap_to_seen(df, real.where("l_linenumber % 3 = 0 and l_quantity % 5 = 0"), ["l_quantity"]).groupBy("x", "l_quantity").agg(F.count(F.lit(1)).alias("n"))


@register("c25_clip", "SELECT c_custkey, GREATEST(0, LEAST(5000, c_acctbal)) AS c_acctbal FROM customer")
def c25(spark, sf):
    return C.clip(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (0.0, 5000.0)})


@register("c26_gaussian_normaliser")
def c26(spark, sf):
    df = _li(spark, sf, *CONT)
    return C.GaussianNormaliser(CONT, {"l_quantity": "uniform", "l_extendedprice": "beta", "l_discount": "truncnorm", "l_tax": "norm"}).fit(df).transform(df)


@register("c26_round_trip", f"SELECT {_KEY}, ROUND(l_quantity, 2) AS l_quantity, ROUND(l_discount, 3) AS l_discount FROM lineitem")
def c26_back(spark, sf):
    cols = ["l_quantity", "l_discount"]
    df = _li(spark, sf, *cols)
    e = C.GaussianNormaliser(cols, {"l_quantity": "uniform", "l_discount": "norm"}).fit(df)
    back = e.inverse(e.transform(df))
    return rounded(rounded(back, "l_quantity", digits=2), "l_discount", digits=3)


_P26 = union_all([f"SELECT '{c}' AS col, ROUND(AVG({c}), 2) AS mean, ROUND(STDDEV_SAMP({c}), 2) AS std, MIN({c}) AS lo, MAX({c}) AS hi FROM lineitem" for c in CONT])


@register("c26_learned_marginals", _P26)
def c26_learned(spark, sf):
    learned = C.GaussianNormaliser(CONT).fit(table(spark, sf, "lineitem")).learned()
    rows = [(c, round(p["mean"], 2), round(p["std"], 2), p["lo"], p["hi"]) for c, p in learned.items()]
    return spark.createDataFrame(rows, "col string, mean double, std double, lo double, hi double")
