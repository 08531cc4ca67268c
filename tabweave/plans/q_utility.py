"""Queries of section F: metrics of prediction tables, and models over lineitem and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import utility as U
from .fixtures import rounded, table, thirds, union_all
from .registry import register

_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register(
    "f01_common_classes",
    "WITH tr AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE o_orderstatus END AS y FROM orders WHERE o_orderkey % 2 = 0), te AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS y FROM orders WHERE o_orderkey % 2 = 1), "
    "k AS (SELECT y, ROW_NUMBER() OVER (ORDER BY y) - 1 AS code FROM (SELECT y FROM tr INTERSECT SELECT y FROM te) b) SELECT o_orderkey, code AS y FROM (SELECT * FROM tr UNION ALL SELECT * FROM te) t JOIN k USING (y)",
)
def f01(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    tr = o.where(k % 2 == 0).select("o_orderkey", F.when(k % 3 == 0, "A").otherwise(F.col("o_orderstatus")).alias("y"))
    te = o.where(k % 2 == 1).select("o_orderkey", F.when(k % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("y"))
    a, b = U.common_classes(tr, te, "y")
    return a.unionByName(b)


@register("f02_class_weights", "WITH k AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, ROUND((SELECT SUM(n) FROM k) / ((SELECT COUNT(*) FROM k) * CAST(n AS DOUBLE)), 6) AS weight FROM orders JOIN k USING (o_orderstatus)")
def f02(spark, sf):
    return rounded(U.class_weights(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus"), "weight")


def _model(method: str, multi: bool = False, task: str = "classification"):
    def query(spark, sf):
        real, fake, hold = thirds(spark, sf)
        y = F.col("l_extendedprice") if task == "regression" else F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) if multi else (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int")
        x = [c for c in _X if c != "l_extendedprice"] if task == "regression" else _X
        return U.evaluate(fake.withColumn("y", y), hold.withColumn("y", y), x, "y", method, task)

    return query


register("f03_linear")(_model("linear", multi=True))
register("f03_linear_regression")(_model("linear", task="regression"))
register("f04_svm")(_model("svm"))
register("f04_svm_regression")(_model("svm", task="regression"))
register("f05_bagging")(_model("bagging"))
register("f06_forest")(_model("forest"))
register("f07_boosting")(_model("boosting"))

_P = "(SELECT quality AS label, n_chars AS score, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction FROM documents JOIN labels USING (doc_id))"


def _preds(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("prediction"))


def _metrics_sql(t: str, g: str) -> str:
    return (
        f"WITH c AS (SELECT {t} AS t, {g} AS g FROM {_P} p), k AS (SELECT DISTINCT t AS c FROM c UNION SELECT DISTINCT g FROM c), "
        "m AS (SELECT c, COUNT(*) FILTER (t = c) AS s, COUNT(*) FILTER (g = c) AS q, COUNT(*) FILTER (t = c AND g = c) AS tp, COUNT(*) AS n FROM k, c x GROUP BY c), "
        "r AS (SELECT s, COALESCE(CAST(tp AS DOUBLE) / NULLIF(s, 0), 0) AS rec, COALESCE(CAST(tp AS DOUBLE) / NULLIF(q, 0), 0) AS pre, COALESCE(CAST(n - s - q + tp AS DOUBLE) / NULLIF(n - s, 0), 0) AS spe FROM m), "
        "o AS (SELECT AVG(CASE WHEN s > 0 THEN rec END) AS balanced_accuracy, SUM(pre * s) / SUM(s) AS \"precision\", SUM(rec * s) / SUM(s) AS recall, SUM(COALESCE(2 * rec * pre / NULLIF(rec + pre, 0), 0) * s) / SUM(s) AS f1, SQRT((SUM(rec * s) / SUM(s)) * (SUM(spe * s) / SUM(s))) AS gmean FROM r) "
        + union_all([f"SELECT '{m}' AS metric, ROUND(\"{m}\", 6) AS value FROM o" for m in ("balanced_accuracy", "precision", "recall", "f1", "gmean")])
    )


@register("f08_classification_swapped", _metrics_sql("prediction", "label"))
def f08(spark, sf):
    return rounded(U.classification_metrics(_preds(spark, sf)), "value")


@register("f08_classification", _metrics_sql("label", "prediction"))
def f08_plain(spark, sf):
    return rounded(U.classification_metrics(_preds(spark, sf), swap=False), "value")


@register("f08_roc_auc", f"SELECT ROUND((SUM(CASE WHEN label = 1 THEN r END) - COUNT(*) FILTER (label = 1) * (COUNT(*) FILTER (label = 1) + 1) / 2.0) / (COUNT(*) FILTER (label = 1) * CAST(COUNT(*) FILTER (label = 0) AS DOUBLE)), 6) AS auc FROM (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {_P} p) q")
def f08_auc(spark, sf):
    return rounded(U.roc_auc(_preds(spark, sf)), "auc")


def _reg_sql(y: str, p: str) -> str:
    return (
        f"WITH t AS (SELECT {y} AS y, {p} AS p FROM (SELECT l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem) z), o AS (SELECT AVG(ABS(y - p)) AS mae, AVG(POWER(y - p, 2)) AS mse, 1 - SUM(POWER(y - p, 2)) / SUM(POWER(y - (SELECT AVG(y) FROM t), 2)) AS r2, AVG(ABS(y - p) / ABS(y)) AS mape, 1 - VAR_POP(y - p) / VAR_POP(y) AS explained_variance FROM t) "
        + union_all([f"SELECT '{m}' AS metric, ROUND({m}, 3) AS value FROM o" for m in ("mae", "mse", "r2", "mape", "explained_variance")])
    )


@register("f09_regression_swapped", _reg_sql("b", "a"))
def f09(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return rounded(U.regression_metrics(li), "value", digits=3)


@register("f09_regression", _reg_sql("a", "b"))
def f09_plain(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return rounded(U.regression_metrics(li, swap=False), "value", digits=3)


@register("f10_utility_gap")
def f10(spark, sf):
    real, fake, hold = (df.withColumn("y", (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int")) for df in thirds(spark, sf))
    return U.utility_gap(real, fake, hold, _X, "y")


@register("f10_utility_gap_regression")
def f10_regression(spark, sf):
    real, fake, hold = thirds(spark, sf)
    return U.utility_gap(real, fake, hold, [c for c in _X if c != "l_extendedprice"], "l_extendedprice", task="regression")


@register("f10_augmentation_gain")
def f10_augment(spark, sf):
    real, fake, hold = (df.withColumn("y", (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int")) for df in thirds(spark, sf))
    return U.utility_gap(real, fake, hold, _X, "y", augment=True)


@register("f11_scaled_utility")
def f11(spark, sf):
    real, fake, hold = thirds(spark, sf)
    return U.scaled_utility(real, [fake.where("l_partkey % 2 = 0"), fake.where("l_partkey % 2 = 1")], hold, [c for c in _X if c != "l_extendedprice"], "l_extendedprice", task="regression")


@register("f11_scaled_utility_classification")
def f11_classes(spark, sf):
    real, fake, hold = (df.withColumn("y", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)) for df in thirds(spark, sf))
    return U.scaled_utility(real, [fake.where("l_partkey % 2 = 0"), fake.where("l_partkey % 2 = 1")], hold, _X, "y", ("lr", "dt", "rf", "mlp"))
