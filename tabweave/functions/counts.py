"""Tagged unpivots and counts that most comparisons of two tables share."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled


def tagged(real: DataFrame, fake: DataFrame, cols: list[str], cast: str | None = None) -> DataFrame:
    """Both tables as one, with ``src`` real or fake, and only ``cols``."""
    pick = lambda df, src: df.select(F.lit(src).alias("src"), *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in cols])
    return pick(real, "real").unionByName(pick(fake, "fake"))


def long_form(df: DataFrame, cols: list[str], ids: list[str], cast: str = "string") -> DataFrame:
    """One row a cell: ids, col, value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast(cast).alias("value")) for c in cols])).alias("x")
    return df.select(*ids, cells).select(*ids, "x.col", "x.value")


def distinct_counts(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """One row, a column each: how many distinct values (null is none) the expressions have.

    Cells are unpivoted and counted by column and value, combined before the one shuffle;
    several exact distinct counts in one aggregation would expand every row by all of them.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("col"), c.cast("string").alias("value")) for n, c in cols.items()])).alias("x")).select("x.*")
    per = cells.where("value is not null").distinct().groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(*[F.coalesce(F.sum(F.when(F.col("col") == n, F.col("n"))), F.lit(0)).alias(n) for n in cols])


def discrete_counts(real: DataFrame, fake: DataFrame, cols: list[str], nulls: bool = False) -> DataFrame:
    """(col, value, n_real, n_fake) over the union of categories; one shuffle, combined before it."""
    cells = long_form(tagged(real, fake, cols, "string"), cols, ["src"])
    cells = cells if nulls else cells.where("value is not null")
    return cells.groupBy("col", "value").agg(F.count_if(F.col("src") == "real").alias("n_real"), F.count_if(F.col("src") == "fake").alias("n_fake"))


def proportions(counts: DataFrame) -> DataFrame:
    """Add p and q: each count's share of its column's total on its side (0 where a side is empty)."""
    w = Window.partitionBy("col")
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(w).cast("double")), F.lit(0.0))
    return counts.withColumn("p", share("n_real")).withColumn("q", share("n_fake"))


def pair_counts(df: DataFrame, cols: list[str], ids: list[str], batch: int = 200) -> DataFrame:
    """(ids, c1, c2, v1, v2, n) for every pair of columns, in batches of pairs so that rows stay narrow."""
    pairs, out = list(combinations(cols, 2)), None
    for k in range(0, len(pairs), batch):
        cells = F.explode(F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).cast("string").alias("v1"), F.col(b).cast("string").alias("v2")) for a, b in pairs[k : k + batch]])).alias("x")
        part = df.select(*ids, cells).groupBy(*ids, "x.c1", "x.c2", "x.v1", "x.v2").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def cumulative_counts(real: DataFrame, fake: DataFrame, cols: list[str], parts: int = 64) -> DataFrame:
    """(col, value, n_real, n_fake, f_real, f_fake, next_value): counts and cumulative shares in value order.

    A two-level prefix sum: each column is cut into ranges at approximate quantiles, totals
    of the ranges are summed up first, then values only within their range; so no column's
    order is one task's work.
    """
    cells = long_form(tagged(real, fake, cols, "double"), cols, ["src"], "double").where("value is not null and not isnan(value)")
    counts = cells.groupBy("col", "value").agg(F.count_if(F.col("src") == "real").alias("n_real"), F.count_if(F.col("src") == "fake").alias("n_fake"))
    shares = [k / parts for k in range(1, parts)]
    bounds = {r["col"]: sorted(set(r["b"])) for r in counts.groupBy("col").agg(F.percentile_approx("value", shares, 1000).alias("b")).collect()}
    part = F.lit(0)
    for c, b in bounds.items():
        part = F.when(F.col("col") == c, F.size(F.filter(F.lit(b), lambda x: x < F.col("value")))).otherwise(part)
    counts = counts.withColumn("part", part)
    by_part = Window.partitionBy("col").orderBy("part")
    totals = counts.groupBy("col", "part").agg(F.sum("n_real").alias("r"), F.sum("n_fake").alias("f"), F.min("value").alias("least"))
    totals = totals.select(
        "col", "part", (F.sum("r").over(by_part) - F.col("r")).alias("r0"), (F.sum("f").over(by_part) - F.col("f")).alias("f0"),
        F.sum("r").over(Window.partitionBy("col")).alias("rn"), F.sum("f").over(Window.partitionBy("col")).alias("fn"), F.lead("least").over(by_part).alias("next_least"),
    )
    w = Window.partitionBy("col", "part").orderBy("value")
    inner = counts.withColumn("cr", F.sum("n_real").over(w)).withColumn("cf", F.sum("n_fake").over(w)).withColumn("nx", F.lead("value").over(w))
    share = lambda a, b, n: F.try_divide((F.col(a) + F.col(b)).cast("double"), F.col(n).cast("double"))
    return inner.join(F.broadcast(totals), ["col", "part"]).select(  # parts rows a column
        "col", "value", "n_real", "n_fake", share("cr", "r0", "rn").alias("f_real"), share("cf", "f0", "fn").alias("f_fake"), F.coalesce("nx", "next_least").alias("next_value")
    )


def with_mean(per_col: DataFrame, value: str, key: str = "col", name: str = "__mean__") -> DataFrame:
    """Append the mean over all rows as one more row, under ``name``; the rows (one a column) are settled, not worked out twice."""
    per_col = settled(per_col.select(key, value), "columns")
    return per_col.select(key, value).unionByName(per_col.agg(F.avg(value).alias(value)).select(F.lit(name).alias(key), value))


def pairs_of(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def inf() -> Column:
    return F.lit(float("inf"))
