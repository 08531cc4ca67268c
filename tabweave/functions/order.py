"""Deterministic order and numbering without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """A hash of seed and keys whose order is a fixed shuffle; other SQL engines compute the same."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A fixed uniform number in [0, 1) from seed and keys: the first 13 hexadecimal digits of ``seeded``."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered(df: DataFrame, order: Column, group: list[str] = (), out: str = "pos", digits: int = 3) -> DataFrame:
    """Number rows from 1 in the order of a hexadecimal hash, within ``group``.

    Rows are bucketed by the first digits of ``order``; bucket sizes are summed up, and only
    buckets are sorted.  A category that most rows share is spread over all buckets.
    """
    return _numbered(df.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, digits)), df.columns, list(group), out)


def numbered_by_value(df: DataFrame, value: Column, group: list[str] = (), out: str = "pos") -> DataFrame:
    """Number rows from 1 in the order of any value, within ``group``: ranges that Spark samples are the buckets."""
    keyed = df.withColumn("_o", value)
    keyed = keyed.repartitionByRange(*[F.col(k) for k in group], F.col("_o")).withColumn("_b", F.spark_partition_id())
    # the ranges are settled: sampled anew they might differ between the count and the numbering
    return _numbered(settled(keyed, "ranges"), df.columns, list(group), out)


def _numbered(keyed: DataFrame, columns: list[str], keys: list[str], out: str) -> DataFrame:
    sizes = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(Window.partitionBy(*keys, F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o")))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    both = ranked.alias("l").join(before.alias("r"), cond)
    return both.select(*[F.col(f"l.{c}") for c in columns], (F.col("l._r") + F.col("r._base")).cast("long").alias(out))


def running_sums(df: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """``df`` with run (sum of ``weight`` up to and with the row, by ``order`` within ``group``), total (the group's last run) and place (from 1, by group and order).

    Rows are cut into sampled ranges of (group, order); only ranges are sorted, whatever a
    group's size.  What is kept a range is its sum and its count.
    """
    keyed = df.repartitionByRange(F.col(group), F.col(order)).withColumn("_b", F.spark_partition_id())
    keyed = settled(keyed, "ranges")
    inner = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.withColumns({"_s": F.sum(F.col(weight).cast("double")).over(inner), "_p": F.row_number().over(Window.partitionBy(group, "_b").orderBy(order))})
    sizes = keyed.groupBy(group, "_b").agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        group, "_b", (F.sum("_w").over(Window.partitionBy(group).orderBy("_b")) - F.col("_w")).alias("_base"), (F.sum("_n").over(Window.orderBy(group, "_b")) - F.col("_n")).alias("_first"),
    )  # fmt: skip  a row a range
    placed = own.join(before, [group, "_b"]).withColumn("run", F.col("_base") + F.col("_s")).withColumn("place", F.col("_first") + F.col("_p"))
    placed = settled(placed.select(*df.columns, "run", "place"), "running")
    return placed.join(placed.groupBy(group).agg(F.max("run").alias("total")), group)


def quantile(df: DataFrame, col: str, share: float, most: int = 10_000) -> float | None:
    """The exact quantile of a column (linear between neighbours), without sorting it whole.

    The range that holds the rank is narrowed at approximate quantiles until ``most`` rows
    are left in it; only those are sorted.  Ties beyond that are one value.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    n, lo, hi = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = (n - 1) * share
    first, below = int(rank), 0
    if n <= most:
        two = [r["x"] for r in x.orderBy("x").offset(first).limit(2).collect()]
        return two[0] + (two[-1] - two[0]) * (rank - first)

    def at(k: int) -> float:
        nonlocal lo, hi, below
        while True:
            inside = x.where(F.col("x").between(lo, hi))
            if lo == hi:
                return lo
            size, cuts = inside.agg(F.count(F.lit(1)), F.percentile_approx("x", [j / 64 for j in range(1, 64)], 1000)).first()
            if size <= most:
                return inside.orderBy("x").offset(k - below).limit(1).first()[0]
            cuts = sorted({c for c in cuts if c < hi})
            if not cuts:
                cuts = [lo]
            part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("x")))
            seen = below
            for r in inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("p").collect():  # 64 rows
                if k < seen + r["n"]:
                    below, lo, hi = seen, r["lo"], r["hi"]
                    break
                seen += r["n"]

    low = at(first)
    if rank == first:
        return low
    lo, hi, below = *x.agg(F.min("x"), F.max("x")).first(), 0
    return low + (at(first + 1) - low) * (rank - first)
