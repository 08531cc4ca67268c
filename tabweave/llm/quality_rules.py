"""Quality rules: a learned decision list over native text statistics.

Statistics come from built-in string and array functions only.  The list is learned by
sequential covering: a rule is a conjunction of thresholds, grown by information gain on
two thirds of the labelled rows, pruned on the rest, and accepted while it stays precise;
rows that it covers leave, and the next rule is grown.  Every step is one aggregation over
the labelled statistics, of which only counts by feature and bin reach the driver.  The
result is an ordered Spark conditional expression.

Nulls: a null text has no words and fails the base rules; null ids and null labels are
never learned from.  Repeated ids are judged row by row.  Without labels, or with labels
of one class, the list is empty and keeps what the base rules keep.  Empty tables give no
rows.  Texts are read whole; only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import SPACES, settled

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
WINDOW = 8
#: Columns that the data contract names.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, and more counts that features are made of; one pass, no shuffle.

    Windows of eight words are hashed by doubling (pairs, then fours, then eights).  Only
    texts with a repeated window go on to find its places.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("*", F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), "").alias("words"), F.filter(F.split("t", "\n"), lambda s: _without(s, SPACES) > 0).alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("t"), SPACES).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - _without(F.col("t"), CAPITALS)).alias("n_capitals"),
        (F.length("t") - _without(F.col("t"), DIGITS)).alias("n_digits"),
        (F.length("t") - _without(F.col("t"), ".!?")).alias("n_stops"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("n_short"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )

    def doubled(name: str, step: int) -> Column:
        h = F.col(name)
        n = F.size(h) - step
        return F.when(n > 0, F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, step + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))

    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("h1"))).withColumn("h2", doubled("h1", 1)).drop("h1")
    rows = rows.withColumn("h4", doubled("h2", 2)).drop("h2")
    rows = rows.withColumn("h8", doubled("h4", 4)).drop("h4")
    rows = rows.withColumn("again", F.size("h8") > F.size(F.array_distinct("h8")))
    rows = rows.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")

    def beside(x: Column, i: Column) -> Column:
        """Whether a neighbour in the sorted windows is equal (there is none beyond the ends)."""
        return F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))

    rows = rows.withColumn("p", F.when(F.col("again"), F.array_sort(F.transform(F.filter("s", beside), lambda x: x["i"])))).drop("s")
    width = F.lit(WINDOW)
    covered = F.aggregate(F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.when(b.isNull(), width).otherwise(F.least(width, b - a))), F.lit(0), lambda x, y: x + y)
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long")).drop("p", "again")


def features() -> dict[str, Column]:
    """Rates that rules put thresholds on, none of which grows with the text's length but n_words itself."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / chars,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
        "distinct_rate": F.col("n_distinct") / words,
        "capital_rate": F.col("n_capitals") / chars,
        "digit_rate": F.col("n_digits") / chars,
        "stop_rate": F.col("n_stops") / words,
        "short_rate": F.col("n_short") / words,
        "line_words": F.col("n_words") / lines,
    }


@dataclass
class Rule:
    """A conjunction of (feature, is_above, bound): the feature exceeds the bound, or does not."""

    terms: list[tuple[str, bool, float]]
    precision: float = 0.0
    rows: int = 0

    def holds(self, columns: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [columns[f] > F.lit(v) if up else columns[f] <= F.lit(v) for f, up, v in self.terms], F.lit(True))


@dataclass
class DecisionList:
    """Ordered rules for what to drop; what no rule covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self, columns: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            out = F.when(rule.holds(columns), F.lit(False)) if out is None else out.when(rule.holds(columns), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def covering(self, columns: dict[str, Column]) -> Column:
        """Number of the first rule that covers a row, null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            out = F.when(rule.holds(columns), F.lit(k)).otherwise(out)
        return out


def learn(labelled: DataFrame, names: list[str], bins: int = 64, most_terms: int = 3, precision: float = 0.95, least_rows: int = 5) -> DecisionList:
    """Learn from ``labelled``: the named feature columns, bad (0 or 1) and grow (boolean), settled.

    Thresholds are approximate quantiles of either class, ``bins`` of each.  A rule grows
    while a term gains information, to ``most_terms`` (so that people can read it), and is
    pruned to the prefix that does best on the pruning rows; its precision there must reach ``precision``, on
    ``least_rows`` rows at least.  Rules are added until none can be, whatever their number:
    each covers at least ``least_rows`` rows that none before it does, so learning ends.
    """
    share = [k / bins for k in range(bins)]
    bounds = labelled.groupBy("bad").agg(*[F.percentile_approx(n, share, 10_000).alias(n) for n in names]).collect()
    cuts = {n: sorted({v for b in bounds for v in b[n] or []}) for n in names}
    if not any(cuts.values()):
        return DecisionList()

    def bin_of(name: str) -> Column:
        bounds = F.lit(cuts[name]) if cuts[name] else F.array().cast("array<double>")
        return F.size(F.filter(bounds, lambda v: v < F.col(name))).alias(f"b_{name}")

    binned = settled(labelled.select("bad", "grow", *names, *[bin_of(n) for n in names]), "binned")
    columns = {n: F.col(n) for n in names}
    found = DecisionList()
    while True:
        left = binned.where(found.verdict(columns))
        rule = Rule([])
        while len(rule.terms) < most_terms:
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"b_{n}").alias("b")) for n in names])).alias("c")
            counts = left.where("grow").where(rule.holds(columns)).select("bad", pairs).groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            term = _best_term(counts, cuts, names)
            if term is None:
                break
            rule.terms.append(term)
        if not rule.terms:
            break
        prefixes = [Rule(rule.terms[: k + 1]) for k in range(len(rule.terms))]
        got = left.where("not grow").agg(*[F.coalesce(F.sum(F.when(r.holds(columns), w)), F.lit(0)).alias(f"{x}{k}") for k, r in enumerate(prefixes) for x, w in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        score = lambda k: (got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"])
        best = max(range(len(prefixes)), key=lambda k: (score(k), -k))
        rows = got[f"p{best}"] + got[f"n{best}"]
        if rows < least_rows or got[f"p{best}"] / rows < precision:
            break
        found.rules.append(Rule(prefixes[best].terms, got[f"p{best}"] / rows, rows))
    return found


def _best_term(counts, cuts: dict[str, list[float]], names: list[str]):
    """The threshold of the highest information gain over rows counted by feature and bin, or None if none gains."""
    by = {n: {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == n} for n in names}
    p0, n0 = (sum(v[i] for v in by[names[0]].values()) for i in (0, 1))
    if not p0 or not n0:
        return None
    base, best, top = math.log2(p0 / (p0 + n0)), None, 1e-9
    for name in names:
        p = n = 0
        for k, bound in enumerate(cuts[name]):
            p, n = p + by[name].get(k, (0, 0))[0], n + by[name].get(k, (0, 0))[1]
            for up, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = a * (math.log2(a / (a + b)) - base) if a else 0
                if gain > top:
                    best, top = (name, up, bound, bound), gain
                elif gain == top and best and best[:2] == (name, up):
                    best = (*best[:3], bound)  # no row lies between: the middle separates best
    return best and (best[0], best[1], (best[2] + best[3]) / 2)


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> tuple[DataFrame, DecisionList]:
    """Judge all rows: doc_id, the base counts, base_failed, kept, rule (the first that covers the row); and the list itself."""
    stats = settled(statistics(df, id_col, text_col), "statistics")
    columns = features()
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_q")).where("_id is not null and _q is not null")
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # the list judges what the base rules let through, and learns from that
    labelled = settled(stats.where(~failed).join(known, stats["doc_id"] == known["_id"]).select((F.col("_q") == 0).cast("int").alias("bad"), grow.alias("grow"), *[c.alias(n) for n, c in columns.items()]), "labelled")
    rules = learn(labelled, list(columns), **options)
    judged = stats.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & rules.verdict(columns)).alias("kept"), rules.covering(columns).alias("rule"))
    return judged, rules
