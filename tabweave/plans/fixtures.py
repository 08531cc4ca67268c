"""Roles of the given tables in the registered queries, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DISC = ["l_returnflag", "l_linestatus", "l_linenumber"]
CONT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EMB = DIMS = 64  # all dimensions of the embeddings

REAL = "(SELECT * FROM lineitem WHERE l_orderkey % 10 < 5)"
FAKE = "(SELECT * FROM lineitem WHERE l_orderkey % 10 BETWEEN 5 AND 7)"
HOLD = "(SELECT * FROM lineitem WHERE l_orderkey % 10 > 7)"
OC = "(SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
OC_REAL = f"(SELECT * FROM {OC} WHERE o_orderkey % 2 = 0)"
OC_FAKE = f"(SELECT * FROM {OC} WHERE o_orderkey % 2 = 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thirds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lineitem as (real, fake, hold) by its order key."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 10
    return li.where(k < 5), li.where(k.between(5, 7)), li.where(k > 7)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders with their customers as (real, fake) by parity of the order key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    oc = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return oc.where("o_orderkey % 2 = 0"), oc.where("o_orderkey % 2 = 1")


def vectors(spark: SparkSession, sf_dir: str, dims: int = EMB) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", k).cast("double").alias(f"e{k}") for k in range(dims)])


EMB_COLS = [f"e{k}" for k in range(EMB)]
ALL_COLS = [f"e{k}" for k in range(DIMS)]
EMB_SQL = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(EMB)) + " FROM embeddings)"


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def cells(cols: list[str], source: str, ids: str = "", cast: str = "VARCHAR") -> str:
    """SQL of the long form of ``source``: ids, col, value."""
    lead = f"{ids}, " if ids else ""
    return union_all([f"SELECT {lead}'{c}' AS col, CAST({c} AS {cast}) AS value FROM {source}" for c in cols])


def counts(cols: list[str], real: str = REAL, fake: str = FAKE, nulls: bool = False) -> str:
    """SQL of CTEs k (col, value, n_real, n_fake) and s (with shares p, q)."""
    keep = "" if nulls else " WHERE value IS NOT NULL"
    return (
        f"a AS ({cells(cols, real)}), b AS ({cells(cols, fake)}), "
        f"u AS (SELECT col, value, 1 AS r, 0 AS f FROM a{keep} UNION ALL SELECT col, value, 0, 1 FROM b{keep}), "
        "k AS (SELECT col, value, CAST(SUM(r) AS BIGINT) AS n_real, CAST(SUM(f) AS BIGINT) AS n_fake FROM u GROUP BY col, value), "
        "s AS (SELECT *, CAST(n_real AS DOUBLE) / SUM(n_real) OVER (PARTITION BY col) AS p, CAST(n_fake AS DOUBLE) / SUM(n_fake) OVER (PARTITION BY col) AS q FROM k)"
    )


def mean_sql(cte: str, value: str, digits: int = 6) -> str:
    """SQL that returns a per-column CTE and its mean, rounded."""
    return f"SELECT col, ROUND({value}, {digits}) AS {value} FROM {cte} UNION ALL SELECT '__mean__', ROUND(AVG({value}), {digits}) FROM {cte}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])
