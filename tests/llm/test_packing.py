"""op10: exact ids, gapless places, and few sequences."""

import zlib
from bisect import bisect_left

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tabweave.llm import packing, queries  # noqa: E402


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(w[3] for w in want)


def test_matches_tokenizer(docs, plain):
    rows = packing.best_fit_packing(docs, queries.tokenizer_path(), 2048).collect()
    n, total = check(rows, list(plain.items()), 2048)
    assert n <= -(-total // 2048) * 1.02 + 1
    r = max(rows, key=lambda r: r["length"])
    assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_odd_rows(odd, odd_rows):
    check(packing.best_fit_packing(odd, queries.tokenizer_path(), 512, keep_ids=False).collect(), [(d, t) for d, t, _ in odd_rows], 512)


def test_odd_spellings(spark):
    texts = ["it's Don't WE'RE", "\x1c a\x1db c\xa0d 　x\x85y", "<|endoftext|> hi <|ENDOFTEXT|>", "ΑΣ İI ÉÀ×÷ é. ß? 12.5, ..., (x), x..", "中文 , “q” x’s naïve—y", "é É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.best_fit_packing(df, queries.tokenizer_path(), 64, keep_ids=False).collect(), list(enumerate(texts)), 64)


def test_ties_beyond_a_block_of_ranks(spark, monkeypatch):
    """Many pieces of one length: matches reach over several blocks of ranks, each rank has one place."""
    monkeypatch.setattr(packing, "BLOCK", 16)
    texts = [(k % 300 or None, "one two three") for k in range(700)] + [(k, "one") for k in range(50)]
    rows = packing.best_fit_packing(spark.createDataFrame(texts, "doc_id long, text string"), queries.tokenizer_path(), 10, keep_ids=False).collect()
    n, total = check(rows, texts, 10)
    assert len(rows) == 750 and n <= 350 + 10


def test_empty(empty):
    assert packing.best_fit_packing(empty, queries.tokenizer_path(), 64, keep_ids=False).count() == 0


def brute_rounds(counts, capacity):
    """The same rounds piece by piece: each request, longest first, takes the smallest gap that suffices; a gap takes one a round."""
    left = {k: v for k, v in counts.items() if k < capacity}
    tokens = sum(k * v for k, v in left.items())
    opened = max(sum(v for k, v in left.items() if 2 * k > capacity), -(-tokens // capacity))
    gaps = [capacity] * opened
    opened += counts.get(capacity, 0)
    while sum(left.values()):
        each = max(1, sum(left.values()) // (8 * max(1, len(gaps))))
        free, grown, placed = sorted(gaps), [], 0
        bundles = sorted(((k * (e := min(each, capacity // k, v)), k, e) for k, v in left.items() if v for _ in range(v // min(each, capacity // k, v))), reverse=True)
        for size, k, e in bundles:
            at = bisect_left(free, size)
            if at < len(free):
                grown.append(free.pop(at) - size)
                left[k] -= e
                placed += e
        gaps = [g for g in free + grown if g]
        if sum(left.values()) and not placed:
            new = -(-sum(k * v for k, v in left.items()) // capacity)
            gaps += [capacity] * new
            opened += new
    return opened


@pytest.mark.parametrize("kind", ["mixed", "tiny", "one", "whole"])
def test_rounds_match_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    counts = {
        "mixed": lambda: {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 201, 1500), return_counts=True))},
        "tiny": lambda: {1: 900, 2: 500, 3: 77}, "one": lambda: {7: 1000}, "whole": lambda: {200: 5, 101: 3},
    }[kind]()
    found = packing.match_rounds(spark.createDataFrame(list(counts.items()), "length long, n long"), 200).collect()
    use, placed = {}, {}
    for m in found:
        for r in range(m["pieces"]):
            use.setdefault(m["sequence"] + r // m["each"], []).append((m["offset"] + r % m["each"] * m["length"], m["length"]))
            placed.setdefault(m["length"], []).append(m["first"] + r)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in counts.items()}
    for places in use.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 200
    total = sum(k * v for k, v in counts.items())
    assert len(use) <= brute_rounds(counts, 200) and (kind == "whole" or len(use) <= -(-total // 200) * 1.02 + 1)
