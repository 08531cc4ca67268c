"""The pipeline's near-duplicate stage: SimHash and pivots propose, real shingles decide."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tabweave.llm import near_copies, simhash_copies

from .test_near_copies import brute_groups, edited, texts  # noqa: F401


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def brute_totals(hashes):
    salts = [k * 0x9E3779B97F4A7C15 for k in range(1, simhash_copies.DIMS // 64 + 1)]
    words = [[int(near_copies.mix(np.array([(h + s) % 2**64], np.uint64))[0]) for s in salts] for h in hashes.tolist()]
    bits = np.array([[(w[d // 64] >> (8 * (d % 64 // 8) + 7 - d % 8)) & 1 for d in range(simhash_copies.DIMS)] for w in words])
    return (2 * bits - 1).sum(axis=0)


def test_the_stage_links_by_its_fingerprints(spark, texts, monkeypatch):  # noqa: F811
    """The stage proposes by SimHash: without a radius only equal fingerprints are proposed, and near copies stay."""
    call = simhash_copies.drop_near_copies
    seen = []
    monkeypatch.setattr(simhash_copies, "drop_near_copies", lambda *a, **k: seen.append(k) or call(*a, **k))
    docs = rows_of(spark, texts)
    assert ids(corpus_pipeline.near_duplicates(spark, docs, "")) == sorted(set(brute_groups(texts)))
    assert seen == [{"shingle": 5, "similarity": 0.8}]
    assert ids(call(docs, radius=-1)) == list(range(len(texts)))


def test_totals_count_bits_over_half():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert simhash_copies.totals(hashes).tolist() == brute_totals(hashes).tolist()


def test_documents_match_all_pairs(docs, plain):
    order = sorted(plain)
    label = brute_groups([plain[d] for d in order])
    assert ids(simhash_copies.drop_near_copies(docs)) == [order[k] for k in sorted(set(label))]


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
def test_pivots_discard_no_near_pair(monkeypatch, step):
    monkeypatch.setattr(simhash_copies, "STEP", step)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (6, 3), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 60)].copy()
    for f in fps:
        for b in rng.integers(0, 192, rng.integers(0, 45)):
            f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    edges = np.array([0, 1, 3, 30, 60])
    i, j, gone = simhash_copies.near_pairs(fps, edges, 56)
    want = {(x, y) for a, z in zip(edges, edges[1:]) for x in range(a, z) for y in range(x + 1, z) if sum(int(v).bit_count() for v in fps[x] ^ fps[y]) <= 56}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    assert gone > 0


def test_small_sets_meet():
    """Sets of four and five, where bits tie most often; and sets at the bound."""
    rng, dealt = np.random.default_rng(6), simhash_copies.groups()
    miss = 0
    for common, one, two in [(4, 0, 1), (8, 1, 1), (40, 5, 5)]:
        for _ in range(300):
            h = rng.integers(0, 1 << 63, common + one + two, dtype=np.uint64) * np.uint64(2)
            a, b = (simhash_copies.totals(x) for x in (h[: common + one], np.append(h[:common], h[common + one :])))
            far = ((a[:192] > 0) != (b[:192] > 0)).sum() > simhash_copies.RADIUS
            miss += far or not (simhash_copies.cells(a, dealt) == simhash_copies.cells(b, dealt)).any()
    assert miss <= 2


@pytest.mark.parametrize("slab", [1 << 21, 250])
@pytest.mark.parametrize("cell", [1024, 8])
def test_hot_cells_and_chained_families(spark, monkeypatch, cell, slab):
    """A third of all rows are near copies in the same cells: hot ones are proposed whole, and nothing is lost."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, rows = words(60), []
    for _ in range(40):
        rows.append(edited(base, rng.sample(range(60), rng.choice([0, 1, 1])), rng))
    for k in range(40):
        rows.append(" ".join(base[: 60 - k] + words(k)))
    rows += [" ".join(words(50)) for _ in range(40)]
    monkeypatch.setattr(simhash_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "SLAB", slab)
    assert ids(simhash_copies.drop_near_copies(rows_of(spark, rows))) == sorted(set(brute_groups(rows)))


def test_short_texts(spark):
    """Under four shingles only equal sets are near copies; four and five of them are."""
    rows = ["a", "a", "A b", "b a", "", None, "a b c d e", "a b c d e f", "a b c d e f g h", "a b c d e f g h i", "p q r s t u v w x", "p q r s t u v w"]
    want = sorted(set(brute_groups(rows)))
    assert ids(simhash_copies.drop_near_copies(rows_of(spark, rows))) == want and 9 not in want and 11 not in want


def test_one_row_a_group_with_odd_ids(spark, texts):  # noqa: F811
    clean = "entirely different words that no other row here has in any order"
    rows = [(None, texts[0]), (5, texts[1]), (None, clean), (7, texts[7]), (7, texts[14]), (3, texts[8]), (8, texts[21]), (8, texts[21]), (None, None), (1, ""), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in simhash_copies.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([(5, texts[1]), (None, clean), (7, texts[14]), (3, texts[8]), (8, texts[21]), (1, ""), (9, "x")], key=str)


def test_no_rows(empty):
    assert simhash_copies.drop_near_copies(empty).count() == 0
