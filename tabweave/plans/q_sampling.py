"""Queries of section D: splits, samples, draws and set operations, all from seeded hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as D
from .fixtures import DISC, OC, REAL, FAKE, cells, halves, rounded, table, thirds, union_all
from .registry import register


def _h(seed: object, *keys: str) -> str:
    return "MD5('" + str(seed) + "'" + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys) + ")"


def _u(seed: object, *keys: str) -> str:
    return f"(CAST('0x' || SUBSTR({_h(seed, *keys)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


_ORD = f"(SELECT o_orderkey, o_orderstatus, o_orderpriority, ROW_NUMBER() OVER (ORDER BY {_h(42, 'o_orderkey')}) AS pos, COUNT(*) OVER () AS n FROM orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register("d01_split", f"SELECT o_orderkey, CASE WHEN pos <= CEIL(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM {_ORD} t")
def d01(spark, sf):
    return D.split(_orders(spark, sf), "o_orderkey").select("o_orderkey", "split")


@register("d01_threshold_split", f"SELECT o_orderkey, CASE WHEN {_u(42, 'o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders")
def d01_threshold(spark, sf):
    return D.split(_orders(spark, sf), "o_orderkey", exact=False).select("o_orderkey", "split")


@register(
    "d02_three_way_split",
    f"WITH a AS (SELECT o_orderkey, pos <= CEIL(n * 0.2) AS t FROM {_ORD} t), b AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {_h(43, 'o_orderkey')}) AS pos, COUNT(*) OVER () AS n FROM a WHERE NOT t) "
    "SELECT o_orderkey, 'test' AS split FROM a WHERE t UNION ALL SELECT o_orderkey, CASE WHEN pos <= CEIL(n * 0.1) THEN 'val' ELSE 'train' END FROM b",
)
def d02(spark, sf):
    return D.three_way_split(_orders(spark, sf), "o_orderkey").select("o_orderkey", "split")


@register("d03_stratified_split", f"SELECT o_orderkey, o_orderstatus, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_h(42, 'o_orderkey')}) <= ROUND(COUNT(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def d03(spark, sf):
    return D.stratified_split(_orders(spark, sf), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "split")


@register("d04_folds", f"SELECT o_orderkey, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM {_ORD} t")
def d04(spark, sf):
    return D.folds(_orders(spark, sf), "o_orderkey").select("o_orderkey", "fold")


_E = "SELECT user_id % 200 AS u, event_type, user_id % 7 AS k FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 200).alias("u"), "event_type", (F.col("user_id") % 7).alias("k"))


@register("d05_distinct_rows", f"SELECT DISTINCT * FROM ({_E}) t")
def d05(spark, sf):
    return D.distinct_rows(_events(spark, sf))


_KEYS = "SELECT l_orderkey % 400 AS a, l_partkey % 50 AS b, CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END AS c FROM {src} z"


def _keys(df):
    return df.select((F.col("l_orderkey") % 400).alias("a"), (F.col("l_partkey") % 50).alias("b"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("c"))


@register("d06_single_rows", f"SELECT a, b, c FROM ({_KEYS.format(src=FAKE)}) t GROUP BY a, b, c HAVING COUNT(*) = 1")
def d06(spark, sf):
    return D.single_rows(_keys(thirds(spark, sf)[1]))


@register("d07_novel_rows", f"SELECT a, b, c FROM ({_KEYS.format(src=FAKE)}) t GROUP BY a, b, c HAVING COUNT(*) = 1 EXCEPT SELECT a, b, c FROM ({_KEYS.format(src='(SELECT * FROM lineitem WHERE l_orderkey % 10 > 7 OR l_orderkey % 10 = 5)')}) r")
def d07(spark, sf):
    li = table(spark, sf, "lineitem")
    return D.novel_rows(_keys(li.where("l_orderkey % 10 > 7 or l_orderkey % 10 = 5")), _keys(thirds(spark, sf)[1]))


@register("d08_fixed_sample", f"SELECT o_orderstatus, o_orderkey, o_orderpriority FROM {_ORD} t WHERE pos <= 500")
def d08(spark, sf):
    return D.fixed_sample(_orders(spark, sf), "o_orderkey", 500, target="o_orderstatus")


@register("d09_sample_grid", union_all([f"SELECT {r} AS row_pct, {c} AS col_pct, COUNT(*) AS n, CAST({k} AS INTEGER) AS n_cols, COUNT(DISTINCT o_orderstatus) AS n_status FROM {_ORD} t WHERE pos <= ROUND(n * {r} / 100)" for r in (10, 50) for c, k in ((50, 2), (100, 4))]))
def d09(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
    grid = D.sample_grid(o, "o_orderkey", [10, 50], [50, 100], "o_orderstatus")
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("n_status")).select(F.lit(r).alias("row_pct"), F.lit(c).alias("col_pct"), "n", F.lit(len(df.columns) - 1).alias("n_cols"), "n_status") for (r, c), df in grid.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_D10 = (
    f"WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_custkey % 100 AS VARCHAR) AS bucket, {_h(42, 'o_orderkey')} AS h FROM orders), "
    f"c AS ({cells(['o_orderstatus', 'o_orderpriority', 'bucket'], 't', 'o_orderkey, h')}), m AS (SELECT DISTINCT ARG_MIN(o_orderkey, h) AS o_orderkey FROM c GROUP BY col, value), "
    "f AS (SELECT o_orderkey FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m) ORDER BY h LIMIT (SELECT GREATEST(0, 300 - COUNT(*)) FROM m)) "
    "SELECT o_orderkey FROM m UNION ALL SELECT o_orderkey FROM f"
)


@register("d10_coverage_sample", _D10)
def d10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 100).cast("string").alias("bucket"))
    return D.coverage_sample(o, "o_orderkey", ["o_orderstatus", "o_orderpriority", "bucket"], 300).select("o_orderkey")


@register("d11_head", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 2000")
def d11(spark, sf):
    return D.head(_orders(spark, sf), "o_orderkey")


@register("d12_augmented", f"SELECT l_returnflag, COUNT(*) AS n FROM (SELECT * FROM {FAKE} f UNION ALL SELECT * FROM {REAL} r) t GROUP BY l_returnflag")
def d12(spark, sf):
    real, fake, _ = thirds(spark, sf)
    return D.augmented(real, fake).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _freq(log: bool, src: str = "lineitem", cols=DISC) -> str:
    w = "LN(n + 1)" if log else "CAST(n AS DOUBLE)"
    return (
        f"c AS ({cells(cols, src)}), k AS (SELECT col, value, COUNT(*) AS n FROM c GROUP BY col, value), "
        f"f AS (SELECT col, value, n, {w} / SUM({w}) OVER (PARTITION BY col) AS prob, SUM({w}) OVER (PARTITION BY col ORDER BY value) / SUM({w}) OVER (PARTITION BY col) AS cum, CAST(ROW_NUMBER() OVER (ORDER BY col, value) - 1 AS INTEGER) AS slot FROM k)"
    )


@register("d13_frequencies", f"WITH {_freq(True)} SELECT col, value, n, ROUND(prob, 6) AS prob, ROUND(cum, 6) AS cum, slot FROM f")
def d13(spark, sf):
    return rounded(D.frequencies(table(spark, sf, "lineitem"), DISC), "prob", "cum")


def _draws(n: int, cols: list[str], seed: int = 42) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in sorted(cols)) + "]"
    return (
        f"d AS (SELECT CAST(draw AS BIGINT) AS draw, {names}[CAST(FLOOR({_u(f'{seed}|col', 'draw')} * {len(cols)}) AS BIGINT) + 1] AS col, {_u(f'{seed}|value', 'draw')} AS u FROM RANGE({n}) r(draw)), "
        "x AS (SELECT draw, d.col, FIRST(value ORDER BY cum) AS value FROM d JOIN f ON f.col = d.col AND (cum > u OR cum > 0.999999999) GROUP BY draw, d.col)"
    )


@register("d14_conditions", f"WITH {_freq(True)}, {_draws(1000, DISC)} SELECT draw, col, value FROM x")
def d14(spark, sf):
    return D.draw_conditions(spark, D.frequencies(table(spark, sf, "lineitem"), DISC), 1000)


_OD = ["o_orderstatus", "o_orderpriority"]
_ROWS = (
    f"z AS (SELECT o_orderkey, col, value, ROW_NUMBER() OVER (PARTITION BY col, value ORDER BY {_h(42, 'o_orderkey', 'col')}) AS pos, COUNT(*) OVER (PARTITION BY col, value) AS size FROM ({{cells}}) q) "
    f"SELECT draw, x.col, x.value, o_orderkey AS row FROM x JOIN z ON z.col = x.col AND z.value = x.value AND pos = CAST(FLOOR({_u('42|row', 'draw')} * size) AS BIGINT) + 1"
)


@register("d15_condition_rows", f"WITH {_freq(True, 'orders', _OD)}, {_draws(1000, _OD)}, {_ROWS.format(cells=cells(_OD, 'orders', 'o_orderkey'))}")
def d15(spark, sf):
    o = _orders(spark, sf)
    return D.draw_rows(o, "o_orderkey", D.draw_conditions(spark, D.frequencies(o, _OD), 1000), _OD)


@register("d16_original_conditions", f"WITH {_freq(False)}, {_draws(1000, DISC)} SELECT draw, col, value FROM x")
def d16(spark, sf):
    return D.original_conditions(spark, table(spark, sf, "lineitem"), DISC, 1000)


_P = "SELECT {ids}'o_orderstatus|o_orderpriority' AS col, '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS value FROM orders"
_PF = f"c AS ({_P.format(ids='')}), k AS (SELECT col, value, COUNT(*) AS n FROM c GROUP BY col, value), f AS (SELECT col, value, n, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY col) AS prob, CAST(SUM(n) OVER (PARTITION BY col ORDER BY value) AS DOUBLE) / SUM(n) OVER (PARTITION BY col) AS cum FROM k)"


@register("d17_pair_frequencies", f"WITH {_PF} SELECT col, value, n, ROUND(prob, 6) AS prob, ROUND(cum, 6) AS cum FROM f")
def d17(spark, sf):
    return rounded(D.pair_frequencies(_orders(spark, sf), _OD), "prob", "cum")


@register("d17_pair_rows", f"WITH {_PF}, {_draws(500, ['o_orderstatus|o_orderpriority'])}, {_ROWS.format(cells=_P.format(ids='o_orderkey, '))}")
def d17_rows(spark, sf):
    o = _orders(spark, sf)
    return D.draw_pair_rows(o, "o_orderkey", D.draw_conditions(spark, D.pair_frequencies(o, _OD), 500), _OD)


@register("d18_matching", f"SELECT o_orderkey, CAST(150000 AS DOUBLE) AS o_totalprice, o_orderstatus FROM {OC} t WHERE o_orderstatus = 'O' AND ABS(o_totalprice - 150000) <= 150000 * 0.05")
def d18(spark, sf):
    real, fake = halves(spark, sf)
    return D.matching(real.unionByName(fake), {"o_orderstatus": "O", "o_totalprice": 150000.0}, rtol=0.05).select("o_orderkey", "o_totalprice", "o_orderstatus")


_REQ = "q AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY o_orderstatus, o_orderpriority) AS INTEGER) AS request, o_orderstatus, o_orderpriority, 40 * (LENGTH(o_orderpriority) - 4) AS num_rows FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) d)"
_POOL = f"p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {_h(42, 'o_orderkey')}) AS pos FROM orders)"


def _requests(spark, sf):
    from pyspark.sql import Window

    o = _orders(spark, sf)
    q = o.select("o_orderstatus", "o_orderpriority").distinct().withColumn("request", F.row_number().over(Window.orderBy("o_orderstatus", "o_orderpriority")))
    return q.withColumn("num_rows", 40 * (F.length("o_orderpriority") - 4)), o


@register("d19_fulfil", f"WITH {_REQ}, {_POOL} SELECT request, o_orderkey FROM q JOIN p USING (o_orderstatus, o_orderpriority) WHERE pos <= num_rows")
def d19(spark, sf):
    q, pool = _requests(spark, sf)
    return D.fulfil(q, pool, ["o_orderstatus", "o_orderpriority"], "o_orderkey")[0].select("request", "o_orderkey")


@register("d19_shortfall", f"WITH {_REQ}, {_POOL}, g AS (SELECT request, COUNT(*) AS got FROM q JOIN p USING (o_orderstatus, o_orderpriority) WHERE pos <= num_rows GROUP BY request) SELECT q.request, CAST(num_rows AS BIGINT) AS num_rows, COALESCE(got, 0) AS got, CAST(num_rows - COALESCE(got, 0) AS BIGINT) AS short FROM q LEFT JOIN g USING (request)")
def d19_short(spark, sf):
    q, pool = _requests(spark, sf)
    return D.fulfil(q, pool, ["o_orderstatus", "o_orderpriority"], "o_orderkey")[1].withColumn("num_rows", F.col("num_rows").cast("long"))


@register(
    "d20_complete_rows",
    f"WITH a AS (SELECT o_orderkey AS known, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_h(42, 'o_orderkey')}) AS pos FROM orders WHERE o_orderkey % 2 = 0), "
    f"b AS (SELECT o_orderkey AS candidate, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_h(42, 'o_orderkey')}) AS pos, COUNT(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders WHERE o_orderkey % 2 = 1) "
    "SELECT known, candidate, o_orderstatus FROM a JOIN b USING (o_orderstatus) WHERE b.pos = (a.pos - 1) % size + 1",
)
def d20(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", "o_orderstatus")
    known, pool = o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "known"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "candidate")
    return D.complete_rows(known, pool, ["o_orderstatus"], "known", "candidate").select("known", "candidate", "o_orderstatus")


_D21 = "WITH k AS (SELECT o_orderstatus AS label, COUNT(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n, label) AS a, ROW_NUMBER() OVER (ORDER BY n DESC, label DESC) AS b FROM k) "


@register("d21_balance_plan", _D21 + "SELECT r.label, r.n, (SELECT MAX(n) FROM k) - r.n AS needed, o.n AS swapped FROM r JOIN r o ON r.b = o.a")
def d21(spark, sf):
    return D.balance_plan(_orders(spark, sf), "o_orderstatus")


@register("d21_oversample", "WITH k AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, FALSE AS is_extra, n FROM k UNION ALL SELECT o_orderstatus, TRUE, (SELECT MAX(n) FROM k) - n FROM k WHERE n < (SELECT MAX(n) FROM k)")
def d21_over(spark, sf):
    return D.oversample(_orders(spark, sf), "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "is_extra").agg(F.count(F.lit(1)).alias("n"))


@register("d22_copula_sample")
def d22(spark, sf):
    return D.copula_sample(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], marginal={"l_quantity": "uniform"})
