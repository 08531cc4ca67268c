"""Registered queries run over all that their operators do."""

import pytest

import __spark_entry__ as entry
from tabweave.operators import privacy as G
from tabweave.operators import ranking as H


@pytest.mark.parametrize("name", ["g01_k_anonymity", "g02_l_diversity", "g03_k_map", "g04_delta_presence"])
def test_cluster_queries_use_every_k(spark, sf_dir, monkeypatch, name):
    seen, real = set(), G.cluster_sizes
    monkeypatch.setattr(G, "cluster_sizes", lambda fit_on, score, cols, k, *a, **b: (seen.add(k), real(fit_on, score, cols, k, *a, **b))[1])
    entry.queries()[name](spark, sf_dir)
    assert seen == set(G.CLUSTERS) == {2, 5, 10, 15}


@pytest.mark.parametrize("name, operator", [("g13_linkability", "linkability"), ("g14_inference", "inference")])
def test_neighbour_queries_use_all_dimensions(spark, sf_dir, monkeypatch, name, operator):
    """The real operators run; what they were given is looked at."""
    seen, real = [], getattr(G, operator)
    monkeypatch.setattr(G, operator, lambda *a, **b: (seen.extend(x for x in a if isinstance(x, list)), real(*a, **b))[1])
    assert entry.queries()[name](spark, sf_dir).count() > 0
    assert [f"e{k}" for k in range(64)] == [c for cols in seen for c in cols if c[:1] == "e" and c[1:].isdigit()]
    if name == "g13_linkability":
        assert [len(x) for x in seen] == [32, 32]


def test_bootstrap_query_has_every_replicate(spark, sf_dir):
    rows = entry.queries()["g07_bootstrap"](spark, sf_dir).collect()
    assert sorted(r["replicate"] for r in rows) == list(range(100)) and all(r["dcr_5"] > 0 and 0 < r["nndr_5"] <= 1 for r in rows)


def test_privacy_card_can_be_ranked(spark, sf_dir):
    """Every metric of the card has a direction, and its rows become losses of a trial."""
    card = entry.queries()["g19_score_card"](spark, sf_dir).collect()
    value = {r["metric"]: r["value"] for r in card}
    assert len(value) == len(card) and {f"dp_single_out_{k}_{n}" for n in (1, 2, 4, 8) for k in ("risk", "train_vs_control", "train_vs_naive")} <= set(value)
    assert {f"dp_linkability_{k}" for k in range(4, 11)} <= set(value) and "dp_inference_label" in value
    for plain in ("k_anonymization_synthetic", "l_diversity_synthetic", "k_map", "delta_presence"):
        assert f"dp_{plain}" in value and f"dp_{plain}_exact" in value
    rows = [(t, "success", m, (v or 0.0) + t * 0.01) for t in (0, 1) for m, v in value.items()] + [(2, "failed", "dp_k_map", 0.0)]
    scores = spark.createDataFrame(rows, "tid int, reason string, metric string, value double")
    assert H.oriented(scores).count() == len(rows)
    losses = {r["tid"]: r["loss"] for r in H.rank_losses(scores).collect()}
    assert losses[2] == float("inf") and losses[0] + losses[1] == pytest.approx(-3.0)
