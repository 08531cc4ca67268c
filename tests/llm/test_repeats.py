"""op6 and op8 against brute force, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabweave.llm import core, repeats, substring_dedup, suffix_dedup

from .conftest import SCHEMA, rows_of


def brute_words(rows, n=20):
    """Rows in order of id (null last, by the given order of texts); no row is earlier than another of its id, copies included."""
    order = {t: k for k, t in enumerate(sorted({t or "" for d, t, *_ in rows if d is None}))}
    place = lambda d, t: (d is None, order[t or ""] if d is None else d)
    first = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, place(d, t)), place(d, t))
    out = []
    for d, t, *_ in rows:
        w, seen = (t or "").encode().split(), set()
        m = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if first[k] != place(d, t) or k in seen:
                m[i : i + n] = [True] * n
            seen.add(k)
        out.append((d, len(w), sum(m), hashlib.sha256(b" ".join(x for x, g in zip(w, m) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, n):
    count = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    spans = {}
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                m[i : i + n] = True
        spans[d] = m
        runs = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if len(m) else 0
        out.append((d, len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def words_of(df):
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[4].encode()).hexdigest()) for r in df.collect()), key=str)


def bytes_of(df):
    return sorted(((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in df.collect()), key=str)


def test_words_match_brute_force(docs, plain):
    assert words_of(substring_dedup.substring_dedup(docs)) == brute_words(list(plain.items()))


@pytest.mark.parametrize("group", [256, 1])
def test_bytes_match_brute_force(docs, plain, monkeypatch, group):
    """With GROUP at 1 every group is divided before it is sorted."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    assert bytes_of(suffix_dedup.suffix_dedup(docs)) == brute_bytes(list(plain.items()), 400)


def brute_shared(rows, length=160):
    """Sentence starts whose next bytes stand at a sentence start of another document (rows equal in id and text are one, counted together)."""
    own = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        own.append([b[p : p + length] for p in range(len(b) - length + 1) if p == 0 or b[p - 1] == 10 or p >= 2 and b[p - 2 : p] == b". "])
    seen = {}
    for (d, t, *_), strings in zip(rows, own):
        for x in strings:
            seen.setdefault(x, set()).add((d, t))
    times = Counter((d, t) for d, t, *_ in rows)
    return sorted(((d, times[d, t] * sum(len(seen[x]) > 1 for x in strings)) for (d, t, *_), strings in zip(rows, own)), key=str)


def test_shared_starts_match_brute_force(spark, docs, plain, odd, odd_rows):
    edge = [(1, "." + "a" * 200), (2, " " + "b" * 200 + ". " + "c" * 160), (3, "\n" + "c" * 160), (4, ". " + "c" * 160), (5, "c" * 159), (6, "x. ")]
    for df, rows in ((docs, list(plain.items())), (odd, odd_rows), (spark.createDataFrame(edge, "doc_id long, text string"), edge)):
        got = suffix_dedup.suffix_dedup(df).select("doc_id", "n_shared").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_shared(rows)


def test_odd_rows(odd, odd_rows):
    """Null, repeated and very large ids, each row's fate."""
    assert words_of(substring_dedup.substring_dedup(odd)) == brute_words(odd_rows)
    assert bytes_of(suffix_dedup.suffix_dedup(odd)) == brute_bytes(odd_rows, 400)


def test_hot_keys_are_spread(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(core, "HOT_KEYS", 1_000_000)
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 10_000]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    assert words_of(substring_dedup.substring_dedup(df)) == brute_words(rows)
    assert bytes_of(suffix_dedup.suffix_dedup(df)) == brute_bytes(rows, 400)


def test_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "a"])
def test_two_stage_order(alphabet):
    rng = random.Random(3)
    for size in (1, 2, 17, 400):
        text = "".join(rng.choice(alphabet) for _ in range(size)).encode()
        assert suffix_dedup.suffix_array(text, size + 1).tolist() == sorted(range(size), key=lambda i: text[i:])


def test_repeated_starts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(30)]
    for n in (3, 8, 13):
        count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        want = [[i for i in range(len(t) - n + 1) if count[t[i : i + n]] > 1] for t in texts]
        assert [h.tolist() for h in suffix_dedup.repeated_starts(texts, n)] == want


def test_promising_stretches_hold_all_repeats():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    for n in (9, 12, 16):
        count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - n + 1) if count[t[i : i + n]] > 1}
        kept = suffix_dedup.promising(texts, n)
        assert all(texts[k][a : a + len(p)] == p and len(p) >= n for k, a, p in kept)
        found = {(k, a + i) for k, a, p in kept for i in range(len(p) - n + 1)}
        assert want <= found and len(found) == sum(len(p) - n + 1 for _, _, p in kept)
        hits = suffix_dedup.repeated_starts([p for _, _, p in kept], n)
        assert {(k, a + int(i)) for (k, a, _), h in zip(kept, hits) for i in h} == want


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 5, 5, 900, 3000])
    text, start, count, _, _ = repeats.text_runs(data, offsets, "byte", 50, 12)
    seen = Counter((t, s + k) for t, s, c in zip(text, start, count) for k in range(c))
    want = {(t, i) for t in range(4) for i in range(offsets[t + 1] - offsets[t] - 49)}
    assert set(seen) == want and max(seen.values()) == 1
