"""Queries of section A: tables written to the shared folder and read back in each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import fresh_path
from ..sources import runs, tables
from ..spec import TableSpec
from .fixtures import CONT, DISC, table, union_all
from .registry import register

_LI = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"


@register("a01_read_headerless", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS quantity, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
def a01(spark, sf):
    path = fresh_path(spark, "headerless")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    junk = spark.range(1).select(F.lit("|1x3 Cross validator").alias("value"))
    lines = li.select(F.concat_ws(", ", *[F.col(c).cast("string") for c in li.columns]).alias("value"))
    junk.unionByName(lines).write.text(path)
    got = tables.read_headerless(spark, path, _LI, junk=r"^\|")
    return got.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("l_orderkey").alias("keys"))


@register("a02_read_headered", "SELECT c_custkey, c_mktsegment, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS cents FROM customer")
def a02(spark, sf):
    path = fresh_path(spark, "headered")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    c.toDF(" c_custkey", "c_name ", " c_acctbal ", "c_mktsegment").write.csv(path, header=True)
    got = tables.read_headered(spark, path, drop=["c_name"])
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", F.round(F.col("c_acctbal").cast("double") * 100).cast("long").alias("cents"))


@register("a03_tsv_round_trip", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def a03(spark, sf):
    path = fresh_path(spark, "tsv")
    tables.write_tsv(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("row")), path, index="row")
    return tables.read_tsv(spark, path, index="row").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_orderpriority")


@register("a04_read_kinds", "SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'continuous' ELSE 'discrete' END AS kind FROM nation")
def a04(spark, sf):
    path = fresh_path(spark, "names")
    n = table(spark, sf, "nation")
    head = n.limit(1).select(F.lit("back,buffer_overflow,normal.").alias("value"))
    head.unionByName(n.select(F.concat(F.col("n_name"), F.lit(": "), F.when(F.col("n_nationkey") % 3 == 0, "continuous").otherwise("symbolic"), F.lit(".")).alias("value"))).write.text(path)
    return tables.read_kinds(spark, path)


@register("a05_assemble", "SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus, o_orderpriority AS y FROM orders")
def a05(spark, sf):
    o, base = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id"), fresh_path(spark, "parts")
    for name, cols in (("num", ["o_totalprice"]), ("cat", ["o_orderstatus"])):
        o.select("row_id", *cols).write.parquet(f"{base}/{name}")
    # the label part comes as two splits, train and validation
    y = o.select("row_id", F.col("o_orderpriority").alias("y"))
    y.where("row_id % 5 <> 0").write.parquet(f"{base}/y_train")
    y.where("row_id % 5 = 0").write.parquet(f"{base}/y_val")
    part = lambda n: spark.read.parquet(f"{base}/{n}")
    out, _ = tables.assemble(part("num"), part("cat"), part("y_train").unionByName(part("y_val")))
    return out


_FILES = "(SELECT DISTINCT 'seg_' || c_mktsegment AS folder, 'fake_' || CAST(c_custkey % 50 AS VARCHAR) || '.csv' AS name, c_custkey % 50 AS epoch FROM customer)"


@register("a06_latest_output", f"SELECT folder, name, epoch, epoch = MAX(epoch) OVER (PARTITION BY folder) AS is_latest FROM {_FILES} f")
def a06(spark, sf):
    c = table(spark, sf, "customer")
    files = c.select(F.concat(F.lit("seg_"), "c_mktsegment").alias("folder"), F.concat(F.lit("fake_"), (F.col("c_custkey") % 50).cast("string"), F.lit(".csv")).alias("name")).distinct()
    return tables.latest_output(files)


@register(
    "a07_parse_runs",
    "SELECT DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN 'test-' ELSE '' END || 'set' || CAST(s_nationkey AS VARCHAR) || '-ctgan-lv_' || CAST(s_nationkey % 3 AS VARCHAR) || '-bs_1000-rownum_' || CAST(100 * s_nationkey AS VARCHAR) || '-losscorcorr_3.55e-02-lossdis_1.10e-08-condvec_' || CAST(s_nationkey % 2 AS VARCHAR) AS run, "
    "'set' || CAST(s_nationkey AS VARCHAR) AS dataset, 'ctgan' AS model, s_nationkey % 2 = 0 AS is_test, s_nationkey % 3 AS loss_version, 1000 AS batch_size, s_nationkey % 2 AS condvec, 100 * s_nationkey AS rownum, CAST(0.0355 AS DOUBLE) AS weight_corr, CAST(1.1e-08 AS DOUBLE) AS weight_dis FROM supplier",
)
def a07(spark, sf):
    k = F.col("s_nationkey")
    text = lambda c: c.cast("string")
    name = F.concat(F.when(k % 2 == 0, "test-").otherwise(""), F.lit("set"), text(k), F.lit("-ctgan-lv_"), text(k % 3), F.lit("-bs_1000-rownum_"), text(100 * k), F.lit("-losscorcorr_3.55e-02-lossdis_1.10e-08-condvec_"), text(k % 2))
    return runs.parse_runs(table(spark, sf, "supplier").select(name.alias("run")).distinct()).drop("epochs")


@register("a08_incremental_scoring", "SELECT c_mktsegment AS run, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def a08(spark, sf):
    path, c = fresh_path(spark, "scores"), table(spark, sf, "customer")
    score = lambda df: df.groupBy(F.col("c_mktsegment").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    tables.append_scores(score(c.where("c_mktsegment < 'F'")), path)
    todo = tables.unscored(c.select(F.col("c_mktsegment").alias("run")).distinct(), spark.read.parquet(path), ["run"])
    tables.append_scores(score(c.join(todo, c["c_mktsegment"] == todo["run"], "left_semi")), path)
    return spark.read.parquet(path)


@register(
    "a09_append_trials",
    "WITH m AS (SELECT user_id AS tid, AVG(value) AS loss FROM events WHERE user_id < 20 GROUP BY user_id), n AS (SELECT user_id - 20 AS tid, AVG(value) AS loss FROM events WHERE user_id BETWEEN 20 AND 39 GROUP BY user_id) "
    "SELECT tid, ROUND(loss, 6) AS loss FROM m UNION ALL SELECT tid + (SELECT MAX(tid) + 1 FROM m), ROUND(loss, 6) FROM n",
)
def a09(spark, sf):
    e = table(spark, sf, "events")
    trials = lambda lo, hi: e.where(F.col("user_id").between(lo, hi)).groupBy((F.col("user_id") - lo).alias("tid")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return tables.append_trials(trials(0, 19), trials(20, 39))


def _info(i: int, c: str, kind: str, role: str) -> str:
    num = kind == "continuous"
    cats = "CAST(NULL AS VARCHAR)" if num else f"(SELECT '[' || STRING_AGG('\"' || v || '\"', ',' ORDER BY v) || ']' FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM lineitem))"
    lo, hi = (f"MIN({c})", f"MAX({c})") if num else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return f"SELECT {i} AS \"index\", '{c}' AS col, '{kind}' AS kind, '{role}' AS role, COUNT(*) AS n, COUNT(*) FILTER ({c} IS NULL) AS n_null, COUNT(DISTINCT {c}) AS n_distinct, {lo} AS lo, {hi} AS hi, {cats} AS categories FROM lineitem"


@register("a10_table_info", union_all([_info(i, c, "continuous" if c in CONT else "discrete", "target" if c == "l_returnflag" else "feature") for i, c in enumerate([*CONT, *DISC])]))
def a10(spark, sf):
    return tables.table_info(table(spark, sf, "lineitem"), TableSpec(CONT, DISC, target="l_returnflag"))
