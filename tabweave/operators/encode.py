"""Section C: cleaning, encoding and decoding.

Every encoder is fitted to a table (``fit``), keeps its state as plain JSON values or as a
small table, and has ``transform`` and, where there is one, ``inverse``.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.counts import long_form
from ..functions.marginals import fitted_marginals
from ..functions.gram import covariances
from ..functions.mixtures import dirichlet_mixture
from ..functions.order import numbered_by_value, uniform

# --- C1, C2, C5, C9, C11, C15, C22, C25: projections -------------------------------------------------


def clean_strings(df: DataFrame, cols: list[str], lower: bool = True, fold: dict[str, str] | None = None) -> DataFrame:
    """Trim (and lower-case) text columns; ``fold`` maps label variants to one label, after that."""
    def one(c: str) -> Column:
        x = F.trim(F.col(c))
        x = F.lower(x) if lower else x
        return reduce(lambda w, kv: w.when(x == kv[0], kv[1]), (fold or {}).items(), F.when(F.lit(False), x)).otherwise(x)

    return df.withColumns({c: one(c) for c in cols})


def strip_all(df: DataFrame) -> DataFrame:
    """Trim every text column."""
    return df.withColumns({c: F.trim(F.col(c)) for c, t in df.dtypes if t == "string"})


def placeholders_to_null(df: DataFrame, cols: list[str], marks: tuple[str, ...] = ("?", "")) -> DataFrame:
    """Text that is only a placeholder (after trimming) becomes null."""
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*marks), F.col(c)) for c in cols})


def fill_by_kind(df: DataFrame, continuous: list[str], discrete: list[str], number: float = -9999999.0, text: str = "empty") -> DataFrame:
    """Nulls become sentinels, one for numbers and one for categories."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(number)) for c in continuous} | {c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c in discrete})


def unfill_by_kind(df: DataFrame, continuous: list[str], discrete: list[str], integers: tuple[str, ...] = (), number: float = -9999999.0, text: str = "empty") -> DataFrame:
    """C22, back: sentinels become null, integer columns are rounded."""
    back = {c: F.when(F.col(c) != number, F.col(c)) for c in continuous}
    back |= {c: F.round(back.get(c, F.col(c))).cast("long") for c in integers}
    return df.withColumns(back | {c: F.when(F.col(c) != text, F.col(c)) for c in discrete})


def minus_one_to_null(df: DataFrame) -> DataFrame:
    """-1, as a number or as text, becomes null in every column."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*[F.when(F.col(c) != (F.lit(-1) if t in number or t.startswith("decimal") else F.lit("-1")), F.col(c)).alias(c) if t == "string" or t in number or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def interval_start(c: Column) -> Column:
    """The first number of an interval such as ``(a, b]``."""
    return F.regexp_extract(c.cast("string"), r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double")


def sentinel_flag(c: Column, sentinel: float = -1) -> Column:
    """1 where a value is there (not the sentinel), else 0."""
    return F.when(c.isNull() | (c == sentinel), 0).otherwise(1)


def to_bits(c: Column, bits: int) -> Column:
    """C11: the lowest ``bits`` bits of an integer, least significant first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", c.cast("long"), i).bitwiseAND(1).cast("int"))


def from_bits(c: Column) -> Column:
    return F.aggregate(F.transform(c, lambda b, i: F.call_function("shiftleft", b.cast("long"), i)), F.lit(0).cast("long"), lambda a, b: a + b)


def conform(df: DataFrame, like: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """The columns of ``like`` in its order and types: missing ones null, extra ones dropped, what does not convert null."""
    fields = [f for f in like.schema.fields if f.name not in exclude]
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def clip(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values below or above the bounds become the bound (null stays)."""
    def one(c: str, lo, hi) -> Column:
        x = F.col(c)
        x = F.when(x < lo, F.lit(lo)).otherwise(x) if lo is not None else x
        return F.when(x > hi, F.lit(hi)).otherwise(x) if hi is not None else x

    return df.withColumns({c: one(c, lo, hi) for c, (lo, hi) in bounds.items()})


# --- steps with state ---------------------------------------------------------------------------------


@dataclass
class Step:
    """A fitted (or to be fitted) encoder; its fields are its state."""

    def fit(self, df: DataFrame) -> "Step":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        return df

    def kinds(self, kinds: dict[str, str]) -> dict[str, str]:
        """Column kinds after this step."""
        return kinds


@dataclass
class DateEncoder(Step):
    """Dates to whole days since ``ref``; what is no date becomes null, and back."""

    cols: list[str]
    ref: str = "1970-01-01"
    format: str = "yyyy-MM-dd"

    def transform(self, df):
        return df.withColumns({c: F.datediff(F.try_to_timestamp(F.col(c).cast("string"), F.lit(self.format)).cast("date"), F.lit(self.ref).cast("date")).cast("double") for c in self.cols})

    def inverse(self, df):
        back = lambda c: F.date_format(F.date_add(F.lit(self.ref).cast("date"), F.round(F.col(c)).cast("int")), self.format)
        return df.withColumns({c: F.when(F.col(c) != -1, back(c)) for c in self.cols})

    def kinds(self, kinds):
        return kinds | {c: "continuous" for c in self.cols}


@dataclass
class MissingEncoder(Step):
    """C4: missing categories become "-1"; missing numbers become the median, with a flag column beside.

    A number of -1 counts as missing too.  Gaussian noise of deviation ``noise_std`` is added
    to the median; it comes from a hash of the row (``id_col``, or else all its columns), so
    it is the same on every run and partitioning.
    """

    continuous: list[str]
    discrete: list[str]
    noise_std: float = 0.0
    seed: int = 42
    medians: dict[str, float] = field(default_factory=dict)
    id_col: str | None = None

    def fit(self, df):
        one = df.agg(*[x for c in self.continuous for x in (F.count_if(F.col(c).isNull() | (F.col(c) == -1)).alias(f"n_{c}"), F.percentile_approx(F.when(F.col(c) != -1, F.col(c).cast("double")), 0.5, 1_000_000).alias(f"m_{c}"))] or [F.lit(1)]).first()
        return MissingEncoder(self.continuous, self.discrete, self.noise_std, self.seed, {c: one[f"m_{c}"] for c in self.continuous if one[f"n_{c}"]}, self.id_col)

    def _noise(self, c: str, columns: list[str]) -> Column:
        """A standard normal number by hash, from two uniform ones (Box and Muller)."""
        keys = [self.id_col] if self.id_col else columns
        u, v = (uniform(f"{self.seed}|{c}|{k}", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in keys]) for k in (0, 1))
        return F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * v)

    def transform(self, df):
        out = {}
        for c, m in self.medians.items():
            gone = F.col(c).isNull() | (F.col(c) == -1)
            fill = F.lit(m) if not self.noise_std else F.lit(m) + self._noise(c, df.columns) * self.noise_std
            out |= {f"{c}_missing": gone.cast("int"), c: F.when(gone, fill).otherwise(F.col(c).cast("double"))}
        return df.withColumns(out | {c: F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in self.discrete})

    def inverse(self, df):
        df = df.withColumns({c: F.when(F.col(f"{c}_missing") < 0.5, F.col(c)) for c in self.medians} | {c: F.when(F.col(c) != "-1", F.col(c)) for c in self.discrete})
        return df.drop(*[f"{c}_missing" for c in self.medians])

    def kinds(self, kinds):
        return kinds | {f"{c}_missing": "binary" for c in self.medians}


#: Pairs of values of which the second is 1, in any case of letters; of a pair with -1 the other is (fixed rules).
BINARY_RULES = (("0", "1"), ("false", "true"), ("no", "yes"), ("n", "y"), ("f", "m"))


def few_values(df: DataFrame, cols: list[str], most: int) -> dict[str, list[str]]:
    """The distinct values of each column, as sorted text; an error if there are more than ``most``, before any are gathered."""
    about = df.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in cols]).first()
    if many := [c for c in cols if about[c] > most * 1.1 + 1]:
        raise ValueError(f"{', '.join(many)}: more than {most} values")
    cells = long_form(df, cols, []).where("value is not null").distinct()
    found = cells.groupBy("col").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()
    out = {c: next((r["v"] for r in found if r["col"] == c), []) for c in cols}
    if many := [c for c in cols if len(out[c]) > most]:
        raise ValueError(f"{', '.join(many)}: more than {most} values")
    return out


@dataclass
class BinaryEncoder(Step):
    """Two-valued columns to 0 and 1 by a rule table, and back (above 0.5 is 1); null stays.

    Other pairs are an error, or, with ``others`` sorted, taken in sorted order.
    """

    cols: list[str]
    values: dict[str, list[str]] = field(default_factory=dict)
    others: str = "error"

    def fit(self, df):
        seen, found = few_values(df, self.cols, 2), {}
        for c in self.cols:
            low = [v.strip().lower() for v in seen[c]]
            rule = next((r for r in BINARY_RULES if set(r) == set(low) and len(low) == 2), None)
            if len(low) != 2 or not rule and "-1" not in low and self.others != "sorted":
                raise ValueError(f"{c} has the values {seen[c]}, which are no known pair")
            first = low.index(rule[0] if rule else "-1" if "-1" in low else low[0])
            found[c] = [seen[c][first], seen[c][1 - first]]
        return BinaryEncoder(self.cols, found, self.others)

    def transform(self, df):
        return df.withColumns({c: F.when(F.col(c).cast("string") == v[1], 1).when(F.col(c).cast("string") == v[0], 0) for c, v in self.values.items()})

    def inverse(self, df):
        return df.withColumns({c: F.when(F.col(c) > 0.5, v[1]).when(F.col(c).isNotNull(), v[0]) for c, v in self.values.items()})

    def kinds(self, kinds):
        return kinds | {c: "binary" for c in self.cols}


def vocabulary(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(grp, value, code): the values of each group of columns in sorted order, numbered from 0.

    ``groups`` maps columns to a group name; columns of one group share codes.  The
    numbering is in ranges of values, so that a large vocabulary is no single task's work.
    """
    cells = long_form(df, list(groups), []).where("value is not null")
    grp = reduce(lambda w, kv: w.when(F.col("col") == kv[0], kv[1]), groups.items(), F.when(F.lit(False), ""))
    values = cells.select(grp.alias("grp"), "value").distinct()
    return numbered_by_value(values, F.col("value"), ["grp"], "code").withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, vocab: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Values to codes by equi-joins; null and unseen values become null."""
    for c, g in groups.items():
        v = vocab.where(F.col("grp") == g).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(v, F.col(c).cast("string") == F.col("_v"), "left").withColumn(c, F.col("_c")).drop("_v", "_c")
    return df


def label_decode(df: DataFrame, vocab: DataFrame, groups: dict[str, str]) -> DataFrame:
    for c, g in groups.items():
        v = vocab.where(F.col("grp") == g).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(v, F.round(F.col(c)).cast("long") == F.col("_c"), "left").withColumn(c, F.col("_v")).drop("_v", "_c")
    return df


@dataclass
class OneHot(Step):
    """Categories to 0/1 arrays with a slot of its own for null; unseen values are all zeros; back by the largest slot."""

    cols: list[str]
    values: dict[str, list[str | None]] = field(default_factory=dict)
    most: int = 10_000

    def fit(self, df):
        seen = few_values(df, self.cols, self.most)
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.cols]).first()
        return OneHot(self.cols, {c: [*seen[c], *([None] if nulls[c] else [])] for c in self.cols}, self.most)

    def transform(self, df):
        return df.withColumns({c: self._slots(c, v) for c, v in self.values.items()})

    @staticmethod
    def _slots(c: str, values: list) -> Column:
        x = F.col(c).cast("string")
        return F.array(*[F.when(x.isNull() if v is None else x.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0) for v in values])

    def inverse(self, df):
        def back(c: str, values: list) -> Column:
            at = F.array_position(F.col(c), F.array_max(F.col(c)))
            return F.when(F.array_max(F.col(c)) > 0, F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), at.cast("int")))

        return df.withColumns({c: back(c, v) for c, v in self.values.items()})


@dataclass
class RankGauss(Step):
    """Values to normal scores of their quantile, piecewise linear between reference quantiles, and back."""

    cols: list[str]
    points: int = 1000
    refs: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df):
        share = np.linspace(0, 1, self.points).tolist()
        one = df.agg(*[F.percentile_approx(F.col(c).cast("double"), share, 10 * self.points).alias(c) for c in self.cols]).first()
        return RankGauss(self.cols, self.points, {c: list(one[c] or []) for c in self.cols})

    def transform(self, df):
        return _by_tables(df, {c: (r, np.linspace(0, 1, len(r)).tolist()) for c, r in self.refs.items() if r})

    def inverse(self, df):
        return _by_tables(df, {c: (r, np.linspace(0, 1, len(r)).tolist()) for c, r in self.refs.items() if r}, back=True)

    def kinds(self, kinds):
        return kinds | {c: "continuous" for c in self.cols}


def _by_tables(df: DataFrame, tables: dict[str, tuple[list[float], list[float]]], back: bool = False, low: float = 1e-7) -> DataFrame:
    """x -> normal quantile of its tabulated distribution function, or back; one vectorised pass over the columns."""

    def forward(grid: np.ndarray, p: np.ndarray):
        @F.pandas_udf("double")
        def f(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float, na_value=np.nan)
            # where the table is flat, the middle of its two readings
            up = np.interp(v, grid, p)
            down = -np.interp(-v, -grid[::-1], -p[::-1])
            return pd.Series(np.where(np.isnan(v), np.nan, normal.ppf(np.clip((up + down) / 2, low, 1 - low)))).where(~np.isnan(v), None)

        return f

    def backward(grid: np.ndarray, p: np.ndarray):
        @F.pandas_udf("double")
        def f(z: pd.Series) -> pd.Series:
            v = z.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.interp(normal.cdf(np.nan_to_num(v)), p, grid)).where(~np.isnan(v), None)

        return f

    make = backward if back else forward
    return df.withColumns({c: make(np.asarray(g, float), np.asarray(p, float))(F.col(c).cast("double")) for c, (g, p) in tables.items()})


@dataclass
class MinMax(Step):
    """C20: to [-1, 1], and back with clipping; integer-like columns are rounded."""

    cols: list[str]
    integers: list[str] = field(default_factory=list)
    bounds: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df):
        one = df.agg(*[x for c in self.cols for x in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]).first()
        return MinMax(self.cols, self.integers, {c: [one[f"lo_{c}"], one[f"hi_{c}"]] for c in self.cols})

    def transform(self, df):
        return df.withColumns({c: 2 * (F.col(c) - lo) / F.lit((hi - lo) or 1.0) - 1 for c, (lo, hi) in self.bounds.items()})

    def inverse(self, df):
        def back(c: str, lo: float, hi: float) -> Column:
            u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))
            x = (u + 1) / 2 * (hi - lo) + lo
            return F.when(F.col(c).isNotNull(), F.round(x) if c in self.integers else x)

        return df.withColumns({c: back(c, lo, hi) for c, (lo, hi) in self.bounds.items()})


@dataclass
class LogTransform(Step):
    """Ln x, ln(x + 1) or ln(x - lower + 1), as the lower bound is above, at or below 0; a sentinel is kept."""

    cols: list[str]
    sentinel: float = -9999999.0
    lower: dict[str, float] = field(default_factory=dict)

    def fit(self, df):
        one = df.agg(*[F.min(F.when(F.col(c) != self.sentinel, F.col(c).cast("double"))).alias(c) for c in self.cols]).first()
        return LogTransform(self.cols, self.sentinel, {c: one[c] for c in self.cols if one[c] is not None})

    def transform(self, df):
        def one(c: str, lo: float) -> Column:
            x = F.col(c).cast("double")
            y = F.ln(x) if lo > 0 else F.ln(x + 1) if lo == 0 else F.ln(x - lo + 1)
            return F.when(x == self.sentinel, x).otherwise(y)

        return df.withColumns({c: one(c, lo) for c, lo in self.lower.items()})

    def inverse(self, df):
        def back(c: str, lo: float) -> Column:
            y = F.col(c)
            x = F.exp(y) if lo > 0 else F.exp(y) - 1 + lo
            x = F.when(x < 0, F.ceil(x).cast("double")).otherwise(x) if lo == 0 else x
            return F.when(y == self.sentinel, y).otherwise(x)

        return df.withColumns({c: back(c, lo) for c, lo in self.lower.items()})


# --- C17-C19: mixtures --------------------------------------------------------------------------------


@dataclass
class ModeNormaliser(Step):
    """A number becomes (component, scaled distance from its mean); special values are modes of their own.

    Spark bins all columns in one aggregation to at most ``bins`` points each, with their
    rows, means and variances; a task a column fits a Dirichlet-process mixture of at most
    ``components`` normals to its points, and components of weight ``least`` or less are
    dropped.  ``pick`` is draw (in proportion to the posterior plus 1e-6, by a hash of
    ``id_col`` and the column) or argmax.  The result columns are c_mode and c_value; modes
    that stand for special values come after the components.  ``bounds`` has the evidence's
    lower bound of each column.
    """

    cols: list[str]
    special: dict[str, list[float]] = field(default_factory=dict)
    components: int = 10
    least: float = 0.005
    bins: int = 4096
    pick: str = "argmax"
    id_col: str | None = None
    seed: int = 42
    clip: float = 0.99
    modes: dict[str, list[list[float]]] = field(default_factory=dict)
    bounds: dict[str, float] = field(default_factory=dict)

    def _plain(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~x.isin(*self.special[c]), x) if self.special.get(c) else x

    def fit(self, df):
        ends = df.agg(*[f(self._plain(c)).alias(f"{n}_{c}") for c in self.cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
        cells = []
        for c in self.cols:
            lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
            if lo is not None:
                step = (hi - lo) / self.bins or 1.0
                cells.append(F.struct(F.lit(c).alias("col"), F.floor((self._plain(c) - lo) / step).cast("int").alias("bin"), self._plain(c).alias("x")))
        if not cells:
            return ModeNormaliser(**(asdict(self) | {"modes": {}, "bounds": {}}))
        points = df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where("x is not null").groupBy("col", "bin").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v"))
        most, least = self.components, self.least

        def fitted(g: pa.Table) -> pa.Table:  # at most bins rows
            g = g.sort_by("bin")
            (mu, sd, w), bounds = dirichlet_mixture(g["x"].to_numpy(), g["n"].to_numpy(), g["v"].to_numpy(), most, least)
            return pa.table({"col": [g["col"][0].as_py()], "mu": [mu], "sd": [sd], "w": [w], "bound": [bounds[-1]]})

        rows = points.groupBy("col").applyInArrow(fitted, "col string, mu array<double>, sd array<double>, w array<double>, bound double").collect()  # a row a column
        found = {r["col"]: [list(r["mu"]), list(r["sd"]), list(r["w"])] for r in rows}
        return ModeNormaliser(**(asdict(self) | {"modes": {c: found[c] for c in self.cols if c in found}, "bounds": {r["col"]: r["bound"] for r in rows}}))

    def transform(self, df):
        """One Arrow pass a column settles mode and value together, over whole batches."""
        mean_sd = {c: (np.array(mu), np.array(sd), np.array(w)) for c, (mu, sd, w) in self.modes.items()}
        clip, draw = self.clip, self.pick == "draw" and self.id_col is not None

        def chooser(c: str):
            mu, sd, w = mean_sd[c]
            own = np.array(self.special.get(c, []), float)

            @F.pandas_udf("mode int, value double")
            def choose(x: pd.Series, u: pd.Series) -> pd.DataFrame:
                v = x.to_numpy(dtype=float, na_value=np.nan)
                plain = ~np.isnan(v) & ~np.isin(v, own)
                log = np.log(w / sd) - ((v[:, None] - mu) / sd) ** 2 / 2
                if draw:
                    share = np.exp(log - log.max(axis=1, keepdims=True))
                    walk = np.cumsum(share / share.sum(axis=1, keepdims=True) + 1e-6, axis=1)
                    k = np.minimum((walk <= (u.to_numpy(dtype=float) * walk[:, -1])[:, None]).sum(axis=1), len(mu) - 1)
                else:
                    k = np.where(plain, np.nan_to_num(log, nan=-np.inf).argmax(axis=1), 0)
                value = np.clip((v - mu[k]) / (4 * sd[k]), -clip, clip)
                for j, s in enumerate(own):
                    k, value = np.where(v == s, len(mu) + j, k), np.where(v == s, 0.0, value)
                none = np.isnan(v)
                return pd.DataFrame({"mode": pd.Series(k.astype("int32"), dtype="Int32").mask(none), "value": pd.Series(value).where(~none, None)})

            return choose

        for c in self.modes:
            u = uniform(f"{self.seed}|{c}", self.id_col) if draw else F.lit(0.0)
            df = df.withColumn("_m", chooser(c)(F.col(c).cast("double"), u))
            df = df.withColumns({f"{c}_mode": F.col("_m.mode"), f"{c}_value": F.col("_m.value")}).drop(c, "_m")
        return df

    def inverse(self, df):
        for c, (mu, sd, _) in self.modes.items():
            own = self.special.get(c, [])
            at = F.col(f"{c}_mode") + 1
            u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"{c}_value")))
            x = u * 4 * F.element_at(F.lit(sd + [0.0] * len(own)), at) + F.element_at(F.lit(mu + own), at)
            df = df.withColumn(c, x).drop(f"{c}_mode", f"{c}_value")
        return df

    def kinds(self, kinds):
        out = {c: k for c, k in kinds.items() if c not in self.cols}
        return out | {f"{c}_mode": "discrete" for c in self.cols} | {f"{c}_value": "continuous" for c in self.cols}


def slot_order(encoded: DataFrame, mode: str) -> DataFrame:
    """(mode, n, slot): component numbers by descending use (the smaller number first on ties)."""
    used = encoded.where(F.col(mode).isNotNull()).groupBy(F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return used.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), "mode")) - 1)  # a row a component


def reorder_slots(encoded: DataFrame, mode: str) -> DataFrame:
    slots = slot_order(encoded, mode).select(F.col("mode").alias("_m"), F.col("slot").alias("_s"))
    return encoded.join(F.broadcast(slots), F.col(mode) == F.col("_m"), "left").withColumn(mode, F.col("_s")).drop("_m", "_s")


# --- C23, C24 -----------------------------------------------------------------------------------------


def reject_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """The rows with all values within the fitted bounds (nulls pass), and (n, n_rejected)."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, (lo, hi) in bounds.items()])
    return df.where(ok), df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_rejected"))


def snap_to_seen(df: DataFrame, real: DataFrame, cols: list[str], most: int = 10_000) -> DataFrame:
    """Each value becomes the nearest value seen in ``real`` (the smaller on ties); for columns of few values."""
    seen = {c: sorted(float(v) for v in vs) for c, vs in few_values(real.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, most).items()}

    def near(c: str) -> Column:
        best = F.array_min(F.transform(F.lit(seen[c]), lambda v: F.struct(F.abs(v - F.col(c)).alias("d"), v.alias("v"))))
        return F.when(F.col(c).isNotNull(), best["v"])

    return df.withColumns({c: near(c) for c in cols if seen[c]})


# --- C16 ----------------------------------------------------------------------------------------------


@dataclass
class Pca(Step):
    """The fewest principal components that reach a share of the variance, and back.

    Sums of products by partition give all covariances; only that matrix (columns squared)
    is worked on here.  The result is pc0, pc1, ... beside the other columns.
    """

    cols: list[str]
    share: float = 0.95
    mean: list[float] = field(default_factory=list)
    axes: list[list[float]] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)

    def fit(self, df):
        mean, cov, _ = covariances(df, self.cols)
        d = self.cols
        value, vector = np.linalg.eigh(cov)
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(d))] < 0, -1, 1)
        ratio = value / max(value.sum(), 1e-300)
        k = len(d) if self.share >= 1 else int(np.searchsorted(np.cumsum(ratio), self.share - 1e-12) + 1)
        return Pca(self.cols, self.share, mean.tolist(), vector[:, : min(k, len(d))].T.tolist(), ratio.tolist())

    def transform(self, df):
        dot = lambda a: sum((F.lit(w) * (F.col(c).cast("double") - F.lit(m)) for w, c, m in zip(a, self.cols, self.mean)), F.lit(0.0))
        return df.select(*[c for c in df.columns if c not in self.cols], *[dot(a).alias(f"pc{k}") for k, a in enumerate(self.axes)])

    def inverse(self, df):
        back = [sum((F.col(f"pc{k}") * F.lit(a[i]) for k, a in enumerate(self.axes)), F.lit(self.mean[i])).alias(c) for i, c in enumerate(self.cols)]
        return df.select(*[c for c in df.columns if not (c.startswith("pc") and c[2:].isdigit())], *back)


# --- C26 ----------------------------------------------------------------------------------------------


@dataclass
class GaussianNormaliser(Step):
    """Numbers to normal scores of a fitted marginal, and back.

    Marginals norm, uniform, truncnorm, gamma and beta are fitted by likelihood from sums
    over the table; ``best`` takes the one of the best information criterion.  gaussian_kde is a kernel estimate
    over binned rows, empirical the quantiles themselves.
    """

    cols: list[str]
    marginal: str | dict[str, str] = "beta"
    fitted: dict[str, dict] = field(default_factory=dict)

    def fit(self, df):
        kinds = {c: self.marginal if isinstance(self.marginal, str) else self.marginal.get(c, "beta") for c in self.cols}
        return GaussianNormaliser(self.cols, self.marginal, fitted_marginals(df, kinds))

    def transform(self, df):
        return _by_tables(df, {c: (f["grid"], f["cdf"]) for c, f in self.fitted.items()}, low=1e-6)

    def inverse(self, df):
        return _by_tables(df, {c: (f["grid"], f["cdf"]) for c, f in self.fitted.items()}, back=True)

    def learned(self) -> dict[str, dict]:
        """What was learned by column: the family with its parameters and log-likelihood a row, and mean, std, lo and hi."""
        return {c: {k: f[k] for k in ("kind", "params", "log_likelihood", "mean", "std", "lo", "hi")} for c, f in self.fitted.items()}


# --- C13, C14 -----------------------------------------------------------------------------------------


@dataclass
class MixedPreprocessor(Step):
    """Continuous columns by rank, discrete ones one-hot, the rest passed through; back with the types restored."""

    continuous: list[str]
    discrete: list[str]
    types: dict[str, str] = field(default_factory=dict)
    gauss: RankGauss | None = None
    hot: OneHot | None = None

    def fit(self, df):
        return MixedPreprocessor(self.continuous, self.discrete, dict(df.dtypes), RankGauss(self.continuous).fit(df) if self.continuous else None, OneHot(self.discrete).fit(df) if self.discrete else None)

    def transform(self, df):
        df = self.gauss.transform(df) if self.gauss else df
        return self.hot.transform(df) if self.hot else df

    def inverse(self, df):
        df = self.hot.inverse(df) if self.hot else df
        df = self.gauss.inverse(df) if self.gauss else df
        whole = ("tinyint", "smallint", "int", "bigint")
        cast = lambda c: (F.round(F.col(c)) if self.types[c] in whole else F.col(c)).cast(self.types[c])
        return df.withColumns({c: cast(c) for c in [*self.continuous, *self.discrete]})

    def layout(self) -> list[tuple[str, int, str]]:
        """(column, width, activation) of the encoded spans."""
        return [(c, 1, "tanh") for c in self.continuous] + [(c, len(v), "softmax") for c, v in (self.hot.values if self.hot else {}).items()]


@dataclass
class Pipeline:
    """C14: steps in order; column kinds are carried through, and the fitted state is JSON."""

    steps: list[Step]
    kinds: dict[str, str] = field(default_factory=dict)

    def fit_transform(self, df: DataFrame) -> tuple["Pipeline", DataFrame]:
        fitted, kinds = [], dict(self.kinds)
        for s in self.steps:
            s = s.fit(df)
            df, kinds = s.transform(df), s.kinds(kinds)
            fitted.append(s)
        return Pipeline(fitted, kinds), df

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s.transform(d), self.steps, df)

    def inverse(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s.inverse(d), reversed(self.steps), df)

    def to_json(self) -> str:
        return json.dumps({"kinds": self.kinds, "steps": [{"step": type(s).__name__, "state": asdict(s)} for s in self.steps]})

    @classmethod
    def from_json(cls, text: str) -> "Pipeline":
        known = {k.__name__: k for k in (DateEncoder, MissingEncoder, BinaryEncoder, OneHot, RankGauss, MinMax, LogTransform, ModeNormaliser, Pca, GaussianNormaliser, MixedPreprocessor)}
        data = json.loads(text)

        def step(name: str, state: dict) -> Step:
            if name == "MixedPreprocessor":
                state = state | {"gauss": RankGauss(**state["gauss"]) if state["gauss"] else None, "hot": OneHot(**state["hot"]) if state["hot"] else None}
            return known[name](**state)

        return cls([step(s["step"], s["state"]) for s in data["steps"]], data["kinds"])
