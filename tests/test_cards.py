"""Cards of many runs equal the card of each run by itself."""

import math

from pyspark.sql import functions as F

from tabweave.operators import cards, fidelity

ROW = "a string, b string, x double, y double"


def near(p, q):
    if p is None or q is None:
        return p is None and q is None
    return p == q or (math.isnan(p) and math.isnan(q)) or abs(p - q) < 1e-9


def told(spark, real, runs):
    """Cards by both ways: {(run, metric): value}."""
    fakes = spark.createDataFrame([(k, *r) for k, rows in runs.items() for r in rows], f"run string, {ROW}")
    real = spark.createDataFrame(real, ROW)
    once = {(r["run"], r["metric"]): r["value"] for r in cards.score_cards(real, fakes, "run", ["a", "b"], ["x", "y"]).collect()}
    each = {}
    for k in {k for k in runs if k is not None}:
        for r in fidelity.score_card(real, fakes.where(F.col("run") == k).drop("run"), ["a", "b"], ["x", "y"]).collect():
            each[k, r["metric"]] = r["value"]
    return once, each


def test_cards_equal_each_runs_card(spark):
    real = [("u", "p", 1.0, 2.0), ("v", "q", 2.0, 1.0), ("u", "q", 3.5, 0.0), ("v", None, 4.0, 7.5), (None, "p", 4.0, None), ("u", "p", 9.0, 3.0)]
    runs = {
        "same": real,
        "far": [("u", "p", -5.0, 2.0), ("v", "q", 2.5, 8.0), ("w", "q", 3.5, 0.0), ("v", "p", 20.0, 1.0)],
        "lacks": [("u", "p", 1.5, 2.0), ("u", "q", 3.0, 2.5), ("u", "p", 3.5, 4.0)],
        None: [("z", "z", 100.0, 100.0)],
    }
    once, each = told(spark, real, runs)
    assert set(once) == set(each) and len(once) == 24
    assert {k: (once[k], each[k]) for k in each if not near(once[k], each[k])} == {}
    assert once["same", "kolmogorov_smirnov_continuous"] == 0 and math.isinf(once["lacks", "kl_divergence_discrete"]) and not math.isinf(once["far", "chisquare_discrete"])


def test_cards_of_poor_runs(spark):
    """A column without values, and a run of one row: the same values, and the same nulls."""
    real = [("u", "p", 1.0, 2.0), ("v", "q", 2.0, 1.0), ("u", "q", 3.5, 0.5)]
    once, each = told(spark, real, {"empty column": [(None, "p", 1.0, 2.0), (None, "q", 2.0, 5.0)], "one row": [("u", "p", 1.0, 2.0)]})
    assert set(once) == set(each) and {k: (once[k], each[k]) for k in each if not near(once[k], each[k])} == {}


def test_largest_gap_between_a_runs_values(spark):
    """The real distribution grows most between two values of the run."""
    real = spark.createDataFrame([("u", "p", float(v), 0.0) for v in range(100)], ROW)
    fakes = spark.createDataFrame([("k", "u", "p", v, 0.0) for v in (-1.0, 50.5, 200.0, float("nan"))], f"run string, {ROW}")
    got = {r["metric"]: r["value"] for r in cards.score_cards(real, fakes, "run", ["a", "b"], ["x"]).collect()}
    # below 50.5: 51 of 100 against a third; from 99 on: all against two thirds
    assert abs(got["kolmogorov_smirnov_continuous"] - 1 / 3) < 1e-12


def test_no_runs(spark):
    real = spark.createDataFrame([("u", "p", 1.0, 2.0)], ROW)
    assert cards.score_cards(real, spark.createDataFrame([], f"run string, {ROW}"), "run", ["a", "b"], ["x", "y"]).collect() == []
