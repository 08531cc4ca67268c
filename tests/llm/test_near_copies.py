"""The pipeline's near-duplicate stage against Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tabweave.llm import near_copies


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(texts, similarity=0.8):
    """Groups of places that pairs of at least this similarity connect, all pairs compared."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if label[i] != label[j] and (a == b or 5 * both >= 4 * (len(a) + len(b) - both) > 0):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(words, places, rng):
    out = list(words)
    for p in places:
        out[p] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        out.append(" ".join(words))
        out += [edited(words, rng.sample(range(400), n), rng) for n in (1, 4, 6, 8, 20, 60)]
    return out


def test_stage_links_near_copies_by_jaccard(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    label = brute_groups(texts)
    assert kept == sorted(set(label))
    assert 12 < len(kept) < len(texts)


def test_documents_match_all_pairs(docs, plain):
    ids = sorted(plain)
    label = brute_groups([plain[d] for d in ids])
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == [ids[k] for k in sorted(set(label))]


def test_blocks_of_a_large_family(spark, texts, monkeypatch):
    monkeypatch.setattr(near_copies, "SLAB", 700)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == sorted(set(brute_groups(texts)))


@pytest.mark.parametrize("slab", [250, 90])
def test_a_chained_family_is_cut_by_bands(spark, monkeypatch, slab):
    """A third of all rows are one group of near copies, and boilerplate chains others to it: cut by bands, nothing is lost."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base, texts = words(60), []
    for _ in range(40):
        texts.append(edited(base, rng.sample(range(60), rng.choice([0, 1, 1])), rng))
    for k in range(40):  # shares more and more with the group, under the bound and above it
        texts.append(" ".join(base[: 60 - k] + words(k)))
    texts += [" ".join(words(50)) for _ in range(40)]
    monkeypatch.setattr(near_copies, "SLAB", slab)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == sorted(set(brute_groups(texts)))


def test_one_row_a_group_with_odd_ids(spark, texts):
    clean = "entirely different words that no other row here has in any order"
    rows = [(None, texts[0]), (5, texts[1]), (None, clean), (7, texts[7]), (7, texts[14]), (3, texts[8]), (8, texts[21]), (8, texts[21]), (None, texts[28]), (None, texts[28]), (None, None), (1, ""), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in near_copies.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([(5, texts[1]), (None, clean), (7, texts[14]), (3, texts[8]), (8, texts[21]), (None, texts[28]), (1, ""), (9, "x")], key=str)


def test_no_rows(empty):
    assert near_copies.drop_near_copies(empty).count() == 0


def test_bands_meet_at_the_bound():
    """Pairs of similarity 0.8 share a band: all but one in ten thousand are expected to."""
    rng, (odd, flip) = np.random.default_rng(6), near_copies._functions()
    miss = 0
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
        miss += not (near_copies.bands(h[:90], odd, flip) == near_copies.bands(h[10:], odd, flip)).any()
    assert miss <= 1
