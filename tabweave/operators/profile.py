"""Section B: what columns hold, from one aggregation a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import discrete_counts, distinct_counts, long_form, proportions, tagged
from ..spec import TableSpec

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")


def _stack(one: DataFrame, rows: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def content_kinds(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """B1: (col, kind): continuous, date, string or mixed, by content; a column without values is mixed, booleans are continuous."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    text = {c: F.trim(F.col(c).cast("string")) for c in cols}
    aggs = []
    for c in cols:
        number = text[c].try_cast("double").isNotNull() if types[c] != "boolean" else F.col(c).isNotNull()
        aggs += [F.count(c).alias(f"n_{c}"), F.count_if(number).alias(f"num_{c}"), F.count_if(_date(text[c]).isNotNull()).alias(f"date_{c}")]

    def kind(c: str) -> Column:
        n, num, date = (F.col(f"{p}_{c}") for p in ("n", "num", "date"))
        return F.when(n == 0, "mixed").when(num == n, "continuous").when(date == n, "date").when((num == 0) & (date == 0), "string").otherwise("mixed")

    return _stack(df.agg(*aggs), [F.struct(F.lit(c).alias("col"), kind(c).alias("kind")) for c in cols])


def count_kinds(df: DataFrame, spec: TableSpec) -> DataFrame:
    """B2: (col, n_distinct, kind): two values make a binary column, else the declared kind holds."""
    one = distinct_counts(df, {c: F.col(c) for c in spec.columns})
    row = lambda c: F.struct(F.lit(c).alias("col"), F.col(c).alias("n_distinct"), F.when(F.col(c) == 2, "binary").otherwise(spec.kind(c)).alias("kind"))
    return _stack(one, [row(c) for c in spec.columns])


def indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, is_indicator): whether the values are exactly 0 and 1."""
    one = df.agg(*[x for c in cols for x in (F.count_distinct(F.col(c).cast("double")).alias(f"n_{c}"), F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))])
    hit = lambda c: F.coalesce((F.col(f"n_{c}") == 2) & (F.col(f"lo_{c}") == 0) & (F.col(f"hi_{c}") == 1), F.lit(False))
    return _stack(one, [F.struct(F.lit(c).alias("col"), hit(c).alias("is_indicator")) for c in cols])


def value_class(c: Column) -> Column:
    """The narrowest class of one text value: int, float, bool, date or string."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), "int").when(text.try_cast("double").isNotNull(), "float").when(F.lower(text).isin("true", "false"), "bool").when(_date(text).isNotNull(), "date").otherwise("string")


def mixed_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n_classes, is_mixed): columns that hold more than one class of value."""
    one = distinct_counts(df, {c: F.when(F.col(c).isNotNull(), value_class(F.col(c))) for c in cols})
    return _stack(one, [F.struct(F.lit(c).alias("col"), F.col(c).alias("n_classes"), (F.col(c) > 1).alias("is_mixed")) for c in cols])


def numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """The text columns of which every value converts (null does)."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.trim(F.col(c)).try_cast("double").isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if bad[c] == 0]


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Convert text columns to double when every value converts, else leave them."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in numeric_columns(df, cols)})


#: Bounds of the integer types, narrowest first (fixed values).
INTEGER_TYPES = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647))


def narrow_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, lo, hi, type): the smallest type that holds all values; fractions go to float if its range holds them."""
    d = lambda c: F.col(c).cast("double")
    one = df.agg(*[x for c in cols for x in (F.min(d(c)).alias(f"lo_{c}"), F.max(d(c)).alias(f"hi_{c}"), F.bool_and(d(c) == F.rint(d(c))).alias(f"whole_{c}"))])

    def row(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        kind = reduce(lambda k, t: k.when((lo >= t[1]) & (hi <= t[2]), t[0]), INTEGER_TYPES, F.when(lo.isNull(), "void")).otherwise("bigint")
        frac = F.when((lo >= -3.4028235e38) & (hi <= 3.4028235e38), "float").otherwise("double")
        return F.struct(F.lit(c).alias("col"), lo.alias("lo"), hi.alias("hi"), F.when(F.coalesce(F.col(f"whole_{c}"), F.lit(True)), kind).otherwise(frac).alias("type"))

    return _stack(one, [row(c) for c in cols])


def reduce_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the columns cast to their narrow types."""
    types = {r["col"]: r["type"] for r in narrow_types(df, cols).collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if t != "void"})


def compare_summaries(tables: dict[str, DataFrame], cols: list[str], digits: int = 3) -> DataFrame:
    """One row a column, one ``mean (std)`` a table."""
    parts = [df.select(F.lit(name).alias("src"), *[F.col(c).cast("double").alias(c) for c in cols]) for name, df in tables.items()]
    cells = long_form(reduce(lambda a, b: a.unionByName(b), parts), cols, ["src"], "double")
    number = lambda c: F.format_string(f"%.{digits}f", c)
    stats = F.concat(number(F.avg("value")), F.lit(" ("), number(F.stddev_samp("value")), F.lit(")"))
    return cells.groupBy("col").pivot("src", list(tables)).agg(stats)


def missing_rates(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """(col, pct_real, pct_fake): share of nulls in percent."""
    cells = long_form(tagged(real, fake, cols, "string"), cols, ["src"])
    pct = lambda s: (100 * F.avg(F.when(F.col("src") == s, F.col("value").isNull().cast("double"))))
    return cells.groupBy("col").agg(pct("real").alias("pct_real"), pct("fake").alias("pct_fake"))


def category_shares(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """(col, value, p, q): shares of categories on both sides, 0 where missing."""
    return proportions(discrete_counts(real, fake, cols)).select("col", "value", "p", "q")


CONTINUOUS_WIDTH = 11


def encoded_widths(df: DataFrame, spec: TableSpec, alert: int = 1000) -> DataFrame:
    """(col, width, total, alert): columns that an encoding would have; null counts as a category."""
    cats = [c for c in spec.columns if spec.kind(c) != "continuous"]
    # null is marked by a leading sign, so that no value can be taken for it
    one = distinct_counts(df, {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in cats})
    width = lambda c: F.lit(CONTINUOUS_WIDTH).cast("long") if c not in cats else F.col(c).cast("long")
    total = sum((width(c) for c in spec.columns), F.lit(0).cast("long"))
    return _stack(one, [F.struct(F.lit(c).alias("col"), width(c).alias("width"), total.alias("total"), (total > alert).alias("alert")) for c in spec.columns])


def integer_like(df: DataFrame, cols: list[str], most: int = 32) -> DataFrame:
    """(col, n_distinct, is_integer_like): whole numbers with few distinct values."""
    d = lambda c: F.col(c).cast("double")
    whole = df.agg(*[F.bool_and(d(c) == F.rint(d(c))).alias(f"w_{c}") for c in cols])
    one = distinct_counts(df, {f"n_{c}": d(c) for c in cols}).crossJoin(F.broadcast(whole))  # one row each
    return _stack(one, [F.struct(F.lit(c).alias("col"), F.col(f"n_{c}").alias("n_distinct"), F.coalesce((F.col(f"n_{c}") <= most) & F.col(f"w_{c}"), F.lit(False)).alias("is_integer_like")) for c in cols])


def class_coverage(real: DataFrame, fake: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n_real, n_fake, covered): whether fake has as many classes as real."""
    counts = discrete_counts(real, fake, cols)
    out = counts.groupBy("col").agg(F.count_if(F.col("n_real") > 0).alias("n_real"), F.count_if(F.col("n_fake") > 0).alias("n_fake"))
    return out.withColumn("covered", F.col("n_fake") >= F.col("n_real"))


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(rule, col, n): violations of a spec: missing columns, null or repeated keys, values that do not fit their kind."""
    wanted = [*spec.columns, *spec.keys]
    missing = [c for c in dict.fromkeys(wanted) if c not in df.columns]
    there = [c for c in spec.columns if c in df.columns]
    keys = [c for c in spec.keys if c in df.columns]
    rules: list[tuple[str, str, Column]] = []
    for c in there:
        if spec.kind(c) == "continuous":
            rules.append(("not_numeric", c, F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull())))
        elif spec.kind(c) == "binary":
            rules.append(("more_than_two_values", c, F.greatest(F.count_distinct(F.col(c)) - 2, F.lit(0))))
    rules += [("null_key", c, F.count_if(F.col(c).isNull())) for c in keys]
    out = df.sparkSession.createDataFrame([("missing_column", c, 1) for c in missing], "rule string, col string, n long")
    if rules:
        one = df.agg(*[x.cast("long").alias(f"r{i}") for i, (_, _, x) in enumerate(rules)])
        out = out.unionByName(_stack(one, [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("col"), F.col(f"r{i}").alias("n")) for i, (r, c, _) in enumerate(rules)]))
    if keys:
        repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n"))
        out = out.unionByName(repeated.select(F.lit("repeated_key").alias("rule"), F.lit(",".join(keys)).alias("col"), "n"))
    return out


def bin_count(df: DataFrame, col: str) -> int:
    """Freedman-Diaconis: range over 2 IQR n^(-1/3), at least 1."""
    r = df.agg(F.percentile_approx(col, [0.25, 0.75], 10_000).alias("q"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
    if not r["n"]:
        return 1
    width = 2 * (r["q"][1] - r["q"][0]) * r["n"] ** (-1 / 3)
    return max(1, int(-(-(r["hi"] - r["lo"]) // width))) if width > 0 else 1


def histogram(real: DataFrame, fake: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, lo, hi, p_real, p_fake) on bins shared by both tables; bins without rows are left out."""
    bins = bins or bin_count(real, col)
    both = tagged(real, fake, [col], "double").where(F.col(col).isNotNull())
    ends = both.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / F.when(step == 0, 1.0).otherwise(step)))).cast("int")
    counts = both.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count_if(F.col("src") == "real").alias("r"), F.count_if(F.col("src") == "fake").alias("f"))  # one row of ends
    w = Window.partitionBy()
    share = lambda n: F.try_divide(F.col(n).cast("double"), F.sum(n).over(w).cast("double"))
    return counts.select("bin", (F.col("lo") + F.col("bin") * step).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"), share("r").alias("p_real"), share("f").alias("p_fake"))


def density(real: DataFrame, fake: DataFrame, col: str, points: int = 50, bins: int = 256) -> DataFrame:
    """(x, d_real, d_fake): Gaussian kernel density on a shared grid, over binned counts (Scott's bandwidth)."""
    both = tagged(real, fake, [col], "double").where(F.col(col).isNotNull())
    one = both.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    side = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(col).alias("s")).withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    step = (F.col("hi") - F.col("lo")) / bins
    centre = F.col("lo") + (F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / step)) + 0.5) * step
    mass = both.crossJoin(F.broadcast(one)).groupBy("src", centre.alias("c")).agg(F.count(F.lit(1)).alias("m"))  # one row of ends
    grid = one.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("c")) / F.col("h")
    kernel = F.exp(-z * z / 2) / (F.col("h") * F.col("n") * F.sqrt(F.lit(2 * 3.141592653589793)))
    spread = mass.join(F.broadcast(side), "src").crossJoin(F.broadcast(grid))  # both bounded: bins by points
    return spread.groupBy("x").agg(F.sum(F.when(F.col("src") == "real", F.col("m") * kernel).otherwise(0.0)).alias("d_real"), F.sum(F.when(F.col("src") == "fake", F.col("m") * kernel).otherwise(0.0)).alias("d_fake"))
