"""Sums of products of many columns, by partition in Arrow and added up over partitions.

Pairs of columns are summed over the rows that have both.  For d columns a partition sends
six d by d matrices, a row of them a record, so the plan does not grow with the number of
pairs; records of equal row are added in two rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial sums that meet in one task of the first round are a ``FAN``-th of all.
FAN = 32
_PARTS = ("n", "x", "y", "xx", "yy", "xy")


def gram_rows(df: DataFrame, cols: list[str], group: str | None = None) -> DataFrame:
    """(group, i, j, n, x, y, xx, yy, xy): for each pair of columns the sums over rows that have both.

    ``x`` and ``y`` are sums of columns i and j less their means over the whole table, the
    others of their squares and product.  Group values become text; a group has as many
    matrices in each task as the task has groups.  NaN counts as missing.
    """
    d = len(cols)
    num = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]
    key: Column = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    rows = df.select(key, *num)
    centre = rows.agg(*[F.avg(f"v{i}") for i in range(d)]).first()
    centre = np.array([v or 0.0 for v in centre])
    schema = "g string, i int, sums array<double>, part int"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            groups = batch.column(0).dictionary_encode()
            of = groups.indices.to_numpy(zero_copy_only=False)
            names = groups.dictionary.to_pylist()
            for k in np.unique(of[~np.isnan(of)] if of.dtype.kind == "f" else of):
                mine = of == k
                m, v = there[mine], x[mine]
                vm, v2m = v.T @ m, (v * v).T @ m
                sums = np.stack([m.T @ m, vm, vm.T, v2m, v2m.T, v.T @ v], 1)  # i, part, j
                name = names[int(k)]
                total[name] = total[name] + sums if name in total else sums
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * d), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(sums.reshape(d, -1)), pa.list_(pa.float64())), pa.array(np.full(d, part_of(sums), np.int32))], names=["g", "i", "sums", "part"])

    def part_of(sums: np.ndarray) -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() % FAN

    def added(t: pa.Table) -> pa.Table:
        lists = t["sums"].combine_chunks()
        both = lists.flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
        return pa.table({"g": t["g"][:1], "i": t["i"][:1], "sums": pa.array([both], pa.list_(pa.float64())), "part": t["part"][:1]})

    once = rows.mapInArrow(add, schema).groupBy("g", "i", "part").applyInArrow(added, schema)
    whole = once.groupBy("g", "i").applyInArrow(added, schema)
    lists = whole.select("g", "i", *[F.slice("sums", k * d + 1, d).alias(p) for k, p in enumerate(_PARTS)])
    return lists.select("g", "i", F.posexplode(F.arrays_zip(*_PARTS)).alias("j", "s")).select(F.col("g").alias(group or "g"), "i", "j", *[F.col(f"s.{p}").alias(p) for p in _PARTS])


def covariance(kind: str = "samp") -> Column:
    """Covariance of a row of ``gram_rows``: samp over n - 1, pop over n; null where there are too few rows."""
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    return F.when(F.col("n") > (1 if kind == "samp" else 0), top / (F.col("n") - (1 if kind == "samp" else 0)))


def correlation() -> Column:
    """Pearson's r of a row of ``gram_rows``; null where a column does not vary."""
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    varies = (F.col("n") > 1) & (vx > 1e-13 * F.col("xx")) & (vy > 1e-13 * F.col("yy"))
    return F.when(varies, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy))


def covariances(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, sample covariances, correlations) of the columns, pairs over the rows that have both; what is undefined is 0.

    Columns squared numbers reach the driver.
    """
    d = len(cols)
    means = np.array([v or 0.0 for v in df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for c in cols]).first()])
    cov, cor = np.zeros((d, d)), np.eye(d)
    for r in gram_rows(df, cols).select("i", "j", covariance().alias("c"), correlation().alias("r")).collect():
        cov[r["i"], r["j"]], cor[r["i"], r["j"]] = r["c"] or 0.0, (r["r"] or 0.0) if r["i"] != r["j"] else 1.0
    return means, cov, cor
