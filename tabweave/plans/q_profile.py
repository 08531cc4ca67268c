"""Queries of section B: typing and profiling of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as B
from ..spec import TableSpec
from .fixtures import CONT, DISC, FAKE, REAL, cells, counts, rounded, table, thirds, union_all
from .registry import register

#: events as text: an id, a name, a date, and a column of either
_TEXT = "(SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, STRFTIME(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS either, CAST(NULL AS VARCHAR) AS nothing FROM events)"


def _text(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("either"), F.lit(None).cast("string").alias("nothing"))


_TC = ["event_id", "event_type", "day", "either", "nothing"]
_NUM = "COUNT(TRY_CAST({c} AS DOUBLE))"
_DATE = "COUNT(TRY_STRPTIME({c}, '%Y-%m-%d'))"


def _kind_sql(c: str) -> str:
    num, date = _NUM.format(c=c), _DATE.format(c=c)
    return f"SELECT '{c}' AS col, CASE WHEN COUNT({c}) = 0 THEN 'mixed' WHEN {num} = COUNT({c}) THEN 'continuous' WHEN {date} = COUNT({c}) THEN 'date' WHEN {num} = 0 AND {date} = 0 THEN 'string' ELSE 'mixed' END AS kind FROM {_TEXT} t"


@register("b01_content_kinds", union_all([_kind_sql(c) for c in _TC]))
def b01(spark, sf):
    return B.content_kinds(_text(spark, sf), _TC)


_B2 = {"l_linestatus": "discrete", "l_returnflag": "discrete", "l_linenumber": "discrete", "l_quantity": "continuous", "l_tax": "continuous"}


@register("b02_count_kinds", union_all([f"SELECT '{c}' AS col, COUNT(DISTINCT {c}) AS n_distinct, CASE WHEN COUNT(DISTINCT {c}) = 2 THEN 'binary' ELSE '{k}' END AS kind FROM lineitem" for c, k in _B2.items()]))
def b02(spark, sf):
    return B.count_kinds(table(spark, sf, "lineitem"), TableSpec([c for c, k in _B2.items() if k == "continuous"], [c for c, k in _B2.items() if k == "discrete"]))


@register("b03_indicators", union_all([f"SELECT '{c}' AS col, COUNT(DISTINCT {c}) = 2 AND MIN({c}) = 0 AND MAX({c}) = 1 AS is_indicator FROM labels" for c in ("quality", "toxic", "doc_id")]))
def b03(spark, sf):
    return B.indicators(table(spark, sf, "labels"), ["quality", "toxic", "doc_id"])


_CLASS = "CASE WHEN REGEXP_FULL_MATCH({c}, '[+-]?[0-9]+') THEN 'int' WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 'float' WHEN LOWER({c}) IN ('true', 'false') THEN 'bool' WHEN TRY_STRPTIME({c}, '%Y-%m-%d') IS NOT NULL THEN 'date' ELSE 'string' END"


@register("b04_mixed_columns", union_all([f"SELECT '{c}' AS col, COUNT(DISTINCT CASE WHEN {c} IS NOT NULL THEN {_CLASS.format(c=c)} END) AS n_classes, COUNT(DISTINCT CASE WHEN {c} IS NOT NULL THEN {_CLASS.format(c=c)} END) > 1 AS is_mixed FROM {_TEXT} t" for c in _TC]))
def b04(spark, sf):
    return B.mixed_columns(_text(spark, sf), _TC)


@register("b05_coerce_numeric", f"SELECT CAST(event_id AS DOUBLE) AS event_id, event_type, either FROM {_TEXT} t")
def b05(spark, sf):
    return B.coerce_numeric(_text(spark, sf), ["event_id", "event_type", "either"]).select("event_id", "event_type", "either")


def _narrow(c: str) -> str:
    whole = f"BOOL_AND({c} = ROUND({c}))"
    kind = f"CASE WHEN MIN({c}) >= -128 AND MAX({c}) <= 127 THEN 'tinyint' WHEN MIN({c}) >= -32768 AND MAX({c}) <= 32767 THEN 'smallint' WHEN MIN({c}) >= -2147483648 AND MAX({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
    return f"SELECT '{c}' AS col, CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi, CASE WHEN {whole} THEN {kind} ELSE 'float' END AS type FROM lineitem"


_B6 = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


@register("b06_narrow_types", union_all([_narrow(c) for c in _B6]))
def b06(spark, sf):
    return B.narrow_types(table(spark, sf, "lineitem"), _B6)


def _summary(c: str, src: str) -> str:
    return f"(SELECT PRINTF('%.3f (%.3f)', AVG({c}), STDDEV_SAMP({c})) FROM {src} z)"


@register("b07_compare_summaries", union_all([f"SELECT '{c}' AS col, {_summary(c, REAL)} AS real, {_summary(c, FAKE)} AS fake" for c in CONT]))
def b07(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return B.compare_summaries({"real": real, "fake": fake}, CONT)


_HOLES = "(SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q7, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS f3 FROM {src} z)"


def _missing(c: str) -> str:
    side = lambda s: f"(SELECT ROUND(100 * AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM {_HOLES.format(src=s)} y)"
    return f"SELECT '{c}' AS col, {side(REAL)} AS pct_real, {side(FAKE)} AS pct_fake"


@register("b08_missing_rates", union_all([_missing(c) for c in ("q7", "f3", "l_tax")]))
def b08(spark, sf):
    real, fake, _ = thirds(spark, sf)
    holes = lambda df: df.withColumn("q7", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))).withColumn("f3", F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")))
    return rounded(B.missing_rates(holes(real), holes(fake), ["q7", "f3", "l_tax"]), "pct_real", "pct_fake")


@register("b09_category_shares", f"WITH {counts(DISC)} SELECT col, value, ROUND(p, 6) AS p, ROUND(q, 6) AS q FROM s")
def b09(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(B.category_shares(real, fake, DISC), "p", "q")


_WIDTHS = " UNION ALL ".join([f"SELECT '{c}' AS col, CAST(11 AS BIGINT) AS width" for c in CONT] + [f"SELECT '{c}', COUNT(DISTINCT {c}) + CAST(MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem" for c in DISC])


@register("b10_encoded_widths", f"SELECT col, width, CAST(SUM(width) OVER () AS BIGINT) AS total, SUM(width) OVER () > 40 AS alert FROM ({_WIDTHS}) w")
def b10(spark, sf):
    return B.encoded_widths(table(spark, sf, "lineitem"), TableSpec(CONT, DISC), alert=40)


@register("b11_integer_like", union_all([f"SELECT '{c}' AS col, COUNT(DISTINCT {c}) AS n_distinct, COUNT(DISTINCT {c}) <= 32 AND BOOL_AND({c} = ROUND({c})) AS is_integer_like FROM lineitem" for c in ("l_linenumber", "l_quantity", "l_discount")]))
def b11(spark, sf):
    return B.integer_like(table(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_discount"])


_FEW = "(SELECT * FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7 AND l_returnflag <> 'A')"


@register("b12_class_coverage", f"WITH {counts(DISC, REAL, _FEW)} SELECT col, COUNT(*) FILTER (n_real > 0) AS n_real, COUNT(*) FILTER (n_fake > 0) AS n_fake, COUNT(*) FILTER (n_fake > 0) >= COUNT(*) FILTER (n_real > 0) AS covered FROM k GROUP BY col")
def b12(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return B.class_coverage(real, fake.where("l_returnflag <> 'A'"), DISC)


@register(
    "b13_validate",
    "SELECT 'missing_column' AS rule, 'l_comment' AS col, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'not_numeric', 'l_returnflag', COUNT(l_returnflag) FROM lineitem UNION ALL "
    "SELECT 'more_than_two_values', 'l_linenumber', COUNT(DISTINCT l_linenumber) - 2 FROM lineitem UNION ALL SELECT 'null_key', k, 0 FROM (SELECT UNNEST(['l_orderkey', 'l_linenumber']) AS k) UNION ALL "
    "SELECT 'repeated_key', 'l_orderkey,l_linenumber', CAST(SUM(k) AS BIGINT) FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)",
)
def b13(spark, sf):
    return B.validate(table(spark, sf, "lineitem"), TableSpec(["l_returnflag"], ["l_comment"], ["l_linenumber"], keys=["l_orderkey", "l_linenumber"]))


_ALL = f"(SELECT 'real' AS src, l_extendedprice AS x FROM {REAL} a UNION ALL SELECT 'fake', l_extendedprice FROM {FAKE} b)"


@register(
    "b14_histogram",
    f"WITH t AS {_ALL}, e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM t), k AS (SELECT CAST(LEAST(19, FLOOR((x - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, ANY_VALUE(lo) AS l, ANY_VALUE(hi) AS h, COUNT(*) FILTER (src = 'real') AS r, COUNT(*) FILTER (src = 'fake') AS f FROM t, e GROUP BY 1) "
    "SELECT bin, ROUND(l + bin * ((h - l) / 20), 4) AS lo, ROUND(l + (bin + 1) * ((h - l) / 20), 4) AS hi, ROUND(CAST(r AS DOUBLE) / SUM(r) OVER (), 6) AS p_real, ROUND(CAST(f AS DOUBLE) / SUM(f) OVER (), 6) AS p_fake FROM k",
)
def b14(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return rounded(rounded(B.histogram(real, fake, "l_extendedprice", 20), "p_real", "p_fake"), "lo", "hi", digits=4)


@register(
    "b15_density",
    f"WITH t AS {_ALL}, e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM t), s AS (SELECT src, COUNT(*) AS n, STDDEV_SAMP(x) * POWER(COUNT(*), -0.2) AS h FROM t GROUP BY src), "
    "m AS (SELECT src, lo + (LEAST(255, FLOOR((x - lo) / ((hi - lo) / 256))) + 0.5) * ((hi - lo) / 256) AS c, COUNT(*) AS m FROM t, e GROUP BY 1, 2), g AS (SELECT lo + i * (hi - lo) / 49 AS x FROM e, RANGE(50) r(i)), "
    "k AS (SELECT g.x, m.src, SUM(m.m * EXP(-POWER((g.x - m.c) / s.h, 2) / 2) / (s.h * s.n * SQRT(2 * PI()))) AS d FROM m JOIN s USING (src), g GROUP BY ALL) "
    "SELECT ROUND(x, 4) AS x, ROUND(1e6 * SUM(CASE WHEN src = 'real' THEN d END), 4) AS d_real, ROUND(1e6 * SUM(CASE WHEN src = 'fake' THEN d END), 4) AS d_fake FROM k GROUP BY x",
)
def b15(spark, sf):
    real, fake, _ = thirds(spark, sf)
    d = B.density(real, fake, "l_extendedprice")
    return d.select(F.round("x", 4).alias("x"), F.round(1e6 * F.col("d_real"), 4).alias("d_real"), F.round(1e6 * F.col("d_fake"), 4).alias("d_fake"))
