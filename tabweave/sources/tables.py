"""Section A: reading and writing tables, and what is known about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.counts import long_form
from ..functions.scratch import settled
from ..spec import TableSpec


def read_headerless(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", junk: str | None = None) -> DataFrame:
    """A1: delimited text without header; a junk row (a pattern on the raw line) is left out before parsing."""
    if junk is None:
        return spark.read.csv(path, schema=schema, sep=sep, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    lines = spark.read.text(path).where(~F.col("value").rlike(junk))
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return lines.select(F.from_csv("value", kind, {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")


def read_headered(spark: SparkSession, path: str, drop: list[str] = (), schema=None) -> DataFrame:
    """A2: delimited text with header; blanks around names go, and so do the listed columns."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.toDF(*[c.strip() for c in df.columns]).drop(*drop)


def write_tsv(df: DataFrame, path: str, index: str | None = None, mode: str = "error") -> None:
    """A3: tab-separated with header; ``index`` (if given) leads."""
    cols = [index, *[c for c in df.columns if c != index]] if index else df.columns
    df.select(*cols).write.mode(mode).csv(path, sep="\t", header=True)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, index: str | None = None) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return df.drop(index) if index else df


def read_kinds(spark: SparkSession, path: str) -> DataFrame:
    """A4: (name, kind) from lines ``name: type.``; any type but continuous counts as discrete."""
    line = r"^\s*([^:|]+?)\s*:\s*(\w+)\.?\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("name"), F.when(F.regexp_extract("value", line, 2) == "continuous", "continuous").otherwise("discrete").alias("kind"))


def assemble(numeric: DataFrame, categorical: DataFrame, label: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, TableSpec]:
    """A5: one table from separately stored parts, joined on the row id, with positional kinds."""
    out = numeric.join(categorical, row_id).join(label, row_id)
    names = [c for c in out.columns if c != row_id]
    m, p = len(numeric.columns) - 1, len(categorical.columns) - 1
    spec = TableSpec.positional(names, m, p)
    spec.id_col = row_id
    return out, spec


def disassemble(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A5, back: numeric, categorical and label part, each with the row id."""
    return df.select(spec.id_col, *spec.continuous), df.select(spec.id_col, *spec.discrete), df.select(spec.id_col, spec.target)


def latest_output(files: DataFrame, name: str = "name", folder: str = "folder") -> DataFrame:
    """Of ``fake_<epoch>`` files, per folder: the epoch of each and whether it is the largest."""
    epoch = F.regexp_extract(F.col(name), r"fake_(\d+)", 1).try_cast("long")
    known = files.withColumn("epoch", epoch).where("epoch is not null")
    best = known.groupBy(folder).agg(F.max("epoch").alias("_m"))
    return known.join(best, folder).withColumn("is_latest", F.col("epoch") == F.col("_m")).drop("_m")


def unscored(runs: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """The runs that the score table does not hold yet."""
    return runs.join(scores.select(*key).distinct(), key, "left_anti")


def append_scores(new: DataFrame, path: str) -> None:
    """Append the scores of new runs to the table at ``path``."""
    new.write.mode("append").parquet(path)


def append_trials(master: DataFrame, new: DataFrame) -> DataFrame:
    """Master and new trials, the new ones renumbered to follow on (tid + largest + 1)."""
    top = master.agg(F.coalesce(F.max("tid") + 1, F.lit(0)).alias("_top"))
    moved = new.crossJoin(F.broadcast(top)).withColumn("tid", F.col("tid") + F.col("_top")).drop("_top")  # one row
    return master.unionByName(moved)


#: Categories of a column that ``table_info`` lists; a column declared discrete with more of them is an error of its declaration.
MOST_CATEGORIES = 100_000


def table_info(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A10: one row a column: index, kind, role, rows, nulls, distinct values, least and greatest, and the categories as JSON.

    A discrete column with over ``MOST_CATEGORIES`` values raises an error: its list would
    not fit a row.
    """
    cols = [*spec.columns, *([spec.target] if spec.target and spec.target not in spec.columns else [])]
    number = lambda c: spec.kind(c) == "continuous"
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
        aggs += [(F.min(F.col(c).cast("double")) if number(c) else F.lit(None).cast("double")).alias(f"lo_{c}"), (F.max(F.col(c).cast("double")) if number(c) else F.lit(None).cast("double")).alias(f"hi_{c}")]
    # counted by value once; categories are gathered only of columns that were seen to have few
    cells = settled(long_form(df, cols, []).where("value is not null").distinct(), "cells")
    sizes = {r["col"]: r["d"] for r in cells.groupBy("col").agg(F.count(F.lit(1)).alias("d")).collect()}  # a row a column
    named = [c for c in cols if not number(c)]
    if many := [c for c in named if sizes.get(c, 0) > MOST_CATEGORIES]:
        raise ValueError(f"declared discrete, but with over {MOST_CATEGORIES} values: {many}")
    kept = F.when(F.col("col").isin(named), F.col("value"))
    per = cells.groupBy("col").agg(F.count(F.lit(1)).alias("d"), F.to_json(F.array_sort(F.collect_list(kept))).alias("cats"))
    of = lambda c, what: F.max(F.when(F.col("col") == c, F.col(what)))
    wide = per.agg(*[x for c in cols for x in (F.coalesce(of(c, "d"), F.lit(0)).alias(f"distinct_{c}"), (F.lit(None).cast("string") if number(c) else F.coalesce(of(c, "cats"), F.lit("[]"))).alias(f"cats_{c}"))])
    one = df.agg(*aggs).crossJoin(F.broadcast(wide))  # one row each
    row = lambda i, c: F.struct(F.lit(i).alias("index"), F.lit(c).alias("col"), F.lit(spec.kind(c)).alias("kind"), F.lit("target" if c == spec.target else "feature").alias("role"), F.col("n"), F.col(f"nulls_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"), F.col(f"cats_{c}").alias("categories"))
    return one.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(cols)])).alias("x")).select("x.*")


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
