"""Section D: splits, samples, duplicates and set operations.

Everything random is a hash of a seed and a row id, so that results are the same on every
run and for every partitioning.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.counts import long_form
from ..functions.gram import covariances
from ..functions.order import numbered, running_sums, seeded, uniform

# --- D1-D4: splits ------------------------------------------------------------------------------------


def split(df: DataFrame, id_col: str, test: float = 0.2, seed: int = 42, exact: bool = True) -> DataFrame:
    """Add ``split`` (train or test).  Exact: the first ceil(test * n) rows in hash order; else a hash threshold, without a shuffle."""
    if not exact:
        return df.withColumn("split", F.when(uniform(seed, id_col) < test, "test").otherwise("train"))
    total = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(test)).alias("_k"))
    return numbered(df, seeded(seed, id_col)).crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("pos") <= F.col("_k"), "test").otherwise("train")).drop("pos", "_k")  # one row


def three_way_split(df: DataFrame, id_col: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Train, val (a share of train) and test: D1 within D1."""
    outer = split(df, id_col, test, seed)
    inner = split(outer.where("split = 'train'").drop("split"), id_col, val, seed + 1)
    return outer.where("split = 'test'").unionByName(inner.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train")))


def stratified_split(df: DataFrame, id_col: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """D3: of every class round(test * n) rows, the first in hash order, are test."""
    sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * F.lit(test)).alias("_k")).withColumnRenamed(label, "_l")
    ranked = numbered(df, seeded(seed, id_col), [label])
    return ranked.join(sizes, ranked[label].eqNullSafe(sizes["_l"])).withColumn("split", F.when(F.col("pos") <= F.col("_k"), "test").otherwise("train")).drop("pos", "_k", "_l")


def folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: rank in hash order modulo k, so fold sizes differ by one at most."""
    return numbered(df, seeded(seed, id_col)).withColumn("fold", ((F.col("pos") - 1) % k).cast("int")).drop("pos")


# --- D5-D7, D12: duplicates and unions ----------------------------------------------------------------


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows (nulls are equal)."""
    return df.dropDuplicates()


def single_rows(df: DataFrame) -> DataFrame:
    """The rows that occur once."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def novel_rows(real: DataFrame, fake: DataFrame) -> DataFrame:
    """The fake rows that occur once in fake and never in real (nulls are equal)."""
    once, seen = single_rows(fake), real.select(*fake.columns).distinct()
    cond = reduce(lambda a, b: a & b, [once[c].eqNullSafe(seen[c]) for c in fake.columns])
    return once.join(seen, cond, "left_anti")


def augmented(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Synthetic rows, then real rows."""
    return fake.unionByName(real)


# --- D8-D11: samples ----------------------------------------------------------------------------------


def fixed_sample(df: DataFrame, id_col: str, n: int, target: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer): the first in hash order; the target column leads."""
    out = df.withColumn("_h", seeded(seed, id_col)).orderBy("_h", id_col).limit(n).drop("_h")
    return out.select(target, *[c for c in df.columns if c != target]) if target else out


def column_choice(columns: list[str], target: str, percent: int, seed: int = 42) -> list[str]:
    """A share of the other columns, first in hash order, and the target, in the table's order."""
    import hashlib

    others = sorted((c for c in columns if c != target), key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest())
    kept = {target, *others[: len(others) * percent // 100]}
    return [c for c in columns if c in kept]


def sample_grid(df: DataFrame, id_col: str, rows: list[int], cols: list[int], target: str, seed: int = 42) -> dict[tuple[int, int], DataFrame]:
    """Sub-tables for every row percentage and column percentage; the id column is not counted as a column."""
    ranked = numbered(df, seeded(seed, id_col))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    names = [c for c in df.columns if c != id_col]
    out = {}
    for r in rows:
        part = ranked.crossJoin(F.broadcast(total)).where(F.col("pos") <= F.round(F.col("_n") * r / 100))  # one row
        for c in cols:
            out[(r, c)] = part.select(id_col, *column_choice(names, target, c, seed))
    return out


def coverage_sample(df: DataFrame, id_col: str, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """At least one row for every value of every column (the first in hash order), filled up to n rows in hash order."""
    keyed = df.withColumn("_h", seeded(seed, id_col))
    need = long_form(keyed, cols, [id_col, "_h"]).groupBy("col", "value").agg(F.min_by(id_col, F.struct("_h", id_col)).alias("_id")).select("_id").distinct()
    marked = keyed.join(need, keyed[id_col] == need["_id"], "left").withColumn("_extra", F.col("_id").isNull())
    must = marked.where("not _extra")
    count = must.count()
    fill = marked.where("_extra").orderBy("_h", id_col).limit(max(0, n - count))
    return must.unionByName(fill).select(*df.columns)


def head(df: DataFrame, id_col: str, n: int = 2000) -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(id_col).limit(n)


# --- D13-D17: condition draws -------------------------------------------------------------------------


def frequencies(df: DataFrame, cols: list[str], log: bool = True) -> DataFrame:
    """(col, value, n, prob, cum, slot): share of each category, of ln(n + 1) if ``log``, cumulated in value order; slots are numbered over all columns."""
    counts = long_form(df, cols, []).where("value is not null").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    weight = F.ln(F.col("n") + 1) if log else F.col("n").cast("double")
    out = running_sums(counts.withColumn("w", weight), "col", "value", "w")
    return out.select("col", "value", "n", (F.col("w") / F.col("total")).alias("prob"), (F.col("run") / F.col("total")).alias("cum"), (F.col("place") - 1).cast("int").alias("slot"))


def draw_conditions(spark: SparkSession, freq: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N draws of a column (uniformly) and one of its categories (by the table's probability): (draw, col, value).

    A category is a stretch of [0, 1).  Each column's line is cut into as many cells as it
    has categories; a category stands in the cells that it touches, a draw falls into one,
    and they meet by (column, cell): two categories a cell on average, of vocabularies of
    any size.
    """
    sizes = {r["col"]: r["size"] for r in freq.groupBy("col").agg(F.count(F.lit(1)).alias("size")).orderBy("col").collect()}  # a row a column
    if not sizes:
        return spark.createDataFrame([], "draw long, col string, value string")
    pick = F.element_at(F.array(*[F.lit(c) for c in sizes]), (F.floor(uniform(f"{seed}|col", "draw") * len(sizes)) + 1).cast("int"))
    cells = F.element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col("col")).cast("long")
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("col", pick).withColumn("u", uniform(f"{seed}|value", "draw")).withColumn("cell", F.floor(F.col("u") * cells))
    # a category begins where the one before it ends, but for rounding: the least end above u decides
    low = F.greatest(F.lit(0.0), F.col("cum") - F.col("prob") - 1e-12)
    last = F.least(cells - 1, F.floor(F.col("cum") * cells))
    lines = freq.select("col", "value", "cum", low.alias("low"), F.explode(F.sequence(F.least(cells - 1, F.floor(low * cells)), last)).alias("cell"))
    met = draws.join(lines, ["col", "cell"]).where((F.col("cum") > F.col("u")) & (F.col("low") <= F.col("u")))
    return met.groupBy("draw", "col").agg(F.min_by("value", "cum").alias("value"))


def draw_rows(df: DataFrame, id_col: str, conditions: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """For every (draw, col, value) a real row that has the value: (draw, col, value, row).

    Rows are numbered within each category, in hash buckets; a draw takes a number.
    """
    return _draw_cells(long_form(df, cols, [id_col]).where("value is not null"), id_col, conditions, seed)


def original_conditions(spark: SparkSession, df: DataFrame, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Draws at the original frequency of categories."""
    return draw_conditions(spark, frequencies(df, cols, log=False), n, seed)


def pair_cells(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """(ids, col, value) where col is a pair of columns and value its pair of values, both as text of two parts."""
    pairs = [F.struct(F.lit(f"{a}|{b}").alias("col"), F.to_json(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("value")) for a, b in combinations(cols, 2)]
    return df.select(*ids, F.explode(F.array(*pairs)).alias("x")).select(*ids, "x.*")


def pair_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, value, n, prob, cum) for every pair of discrete columns, by raw frequency."""
    counts = pair_cells(df, cols, []).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    out = running_sums(counts, "col", "value", "n")
    return out.select("col", "value", "n", (F.col("n") / F.col("total")).alias("prob"), (F.col("run") / F.col("total")).alias("cum"))


def draw_pair_rows(df: DataFrame, id_col: str, conditions: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """D15 on pairs."""
    return _draw_cells(pair_cells(df, cols, [id_col]), id_col, conditions, seed)


def _draw_cells(cells: DataFrame, id_col: str, conditions: DataFrame, seed: int) -> DataFrame:
    ranked = numbered(cells, seeded(seed, id_col, "col"), ["col", "value"])
    sizes = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("size"))
    wanted = conditions.join(sizes, ["col", "value"]).withColumn("pos", (F.floor(uniform(f"{seed}|row", "draw") * F.col("size")) + 1).cast("long"))
    return wanted.join(ranked, ["col", "value", "pos"]).select("draw", "col", "value", F.col(id_col).alias("row"))


# --- D18-D21: conditions on candidates ----------------------------------------------------------------


def matching(df: DataFrame, conditions: dict[str, object], rtol: float = 0.01) -> DataFrame:
    """Rows that meet all conditions: equality, or for floats a relative tolerance, after which the value is set."""
    fits = [F.abs(F.col(c) - v) <= abs(v) * rtol if isinstance(v, float) else F.col(c) == v for c, v in conditions.items()]
    out = df.where(reduce(lambda a, b: a & b, fits, F.lit(True)))
    return out.withColumns({c: F.lit(v) for c, v in conditions.items() if isinstance(v, float)})


def fulfil(conditions: DataFrame, candidates: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(request, keys, num_rows) from a candidate pool: the rows given to each request, and the shortfalls.

    Candidates of a key are numbered in hash order; requests of a key take consecutive numbers in request order.
    """
    ranked = numbered(candidates, seeded(seed, id_col), keys)
    upto = F.sum("num_rows").over(Window.partitionBy(*keys).orderBy("request"))
    spans = conditions.withColumn("_hi", upto).withColumn("_lo", upto - F.col("num_rows"))
    given = ranked.join(F.broadcast(spans), keys).where((F.col("pos") > F.col("_lo")) & (F.col("pos") <= F.col("_hi")))  # requests are a stated list
    rows = given.select("request", *candidates.columns)
    got = given.groupBy("request").agg(F.count(F.lit(1)).alias("got"))
    short = conditions.join(got, "request", "left").select("request", "num_rows", F.coalesce("got", F.lit(0)).alias("got"), (F.col("num_rows") - F.coalesce("got", F.lit(0))).alias("short"))
    return rows, short


def complete_rows(known: DataFrame, candidates: DataFrame, keys: list[str], known_id: str, cand_id: str, seed: int = 42) -> DataFrame:
    """Every known row gets one candidate with the same keys: its number within the key, modulo the candidates' number."""
    a = numbered(known, seeded(seed, known_id), keys)
    b = numbered(candidates, seeded(seed, cand_id), keys)
    sizes = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    wanted = a.join(sizes, keys).withColumn("pos", (F.col("pos") - 1) % F.col("_size") + 1).drop("_size")
    return wanted.join(b, [*keys, "pos"]).drop("pos")


def balance_plan(df: DataFrame, label: str) -> DataFrame:
    """(label, n, needed, swapped): rows needed to reach the majority, and the class counts in opposite order of size."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    up = counts.withColumn("_a", F.row_number().over(Window.orderBy("n", "label"))).withColumn("_b", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("label"))))
    other = up.select(F.col("_a").alias("_k"), F.col("n").alias("swapped"))
    return up.withColumn("needed", F.max("n").over(w) - F.col("n")).join(other, up["_b"] == other["_k"]).select("label", "n", "needed", "swapped")  # a row a class


def oversample(df: DataFrame, id_col: str, label: str, seed: int = 42) -> DataFrame:
    """``df`` and, of every smaller class, as many drawn rows as the majority has more; ``is_extra`` marks them."""
    plan = balance_plan(df, label).where("needed > 0")
    extra = plan.select(F.col("label").alias("_l"), F.col("n").alias("_n"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("needed"))).alias("_k"))
    extra = extra.withColumn("_pos", (F.floor(uniform(seed, F.col("_l"), F.col("_k")) * F.col("_n")) + 1).cast("long"))
    ranked = numbered(df, seeded(seed, id_col), [label])
    drawn = ranked.join(extra, (ranked[label] == extra["_l"]) & (ranked["pos"] == extra["_pos"])).select(*df.columns)
    return df.withColumn("is_extra", F.lit(False)).unionByName(drawn.withColumn("is_extra", F.lit(True)))


# --- D22: Gaussian copula -----------------------------------------------------------------------------


def copula_sample(df: DataFrame, cols: list[str], n: int | None = None, factor: float = 1.05, marginal: str | dict[str, str] = "beta", seed: int = 42) -> DataFrame:
    """N rows (factor times the table's, by default) of a Gaussian copula fitted to numeric columns.

    Marginals are fitted by ``GaussianNormaliser``, the correlation of the normal scores from
    sums of products by partition; rows are drawn in blocks, each with a generator of its own seed.
    """
    from .encode import GaussianNormaliser

    norm = GaussianNormaliser(cols, marginal).fit(df)
    scores = norm.transform(df.select(*cols))
    _, _, sigma = covariances(scores, cols)
    value, vector = np.linalg.eigh(sigma)
    root = np.linalg.cholesky(vector @ np.diag(np.maximum(value, 1e-9)) @ vector.T)
    rows = n if n is not None else int(round(factor * df.count()))
    block = 10_000

    def draw(batches):
        for batch in batches:
            for b, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = np.random.default_rng([seed, b]).standard_normal((size, len(cols))) @ root.T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size) + b * block), *[pa.array(z[:, k]) for k in range(len(cols))]], names=["row", *cols])

    blocks = df.sparkSession.range(-(-rows // block)).select(F.col("id"), F.least(F.lit(block), F.lit(rows) - F.col("id") * block).cast("long").alias("size"))
    fields = ", ".join(f"`{c}` double" for c in cols)
    return norm.inverse(blocks.mapInArrow(draw, f"row long, {fields}"))

