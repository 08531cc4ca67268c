"""op5 against all pairs."""

import numpy as np
import xxhash

from tabweave.llm import simhash_dedup


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    """Smallest id reachable; ``prints`` is a list of (id, fingerprint)."""
    f = np.array([p for _, p in prints], np.uint64)
    label = list(range(len(f)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, "%016x" % p, least[root(i)]) for i, (d, p) in enumerate(prints)]


def test_matches_brute_force(docs, plain):
    got = sorted(tuple(r) for r in simhash_dedup.simhash_dedup(docs).collect())
    assert got == sorted(brute_components([(d, brute_print(t)) for d, t in plain.items()], 2))


def test_large_cell_and_small_pieces(spark, monkeypatch):
    """Many near fingerprints in one cell, cut along pivots and dealt in blocks."""
    monkeypatch.setattr(simhash_dedup, "CELL", 16)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 24, (300, 3))}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    ids = list(enumerate(sorted(prints)))
    points = spark.createDataFrame([(p,) for _, p in ids], "fp long")
    linked = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.links(points, 2)).collect()}
    want = brute_components(ids, 2)
    groups, mine = {}, {}
    for (i, p), (_, _, c) in zip(ids, want):
        groups.setdefault(c, set()).add(p)
        mine.setdefault(linked.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_pivot_filter_loses_nothing():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    i, j = simhash_dedup.near_pairs(a, b, simhash_dedup.pivots(), 2)
    want = {(x, y) for x in range(300) for y in range(300) if int(a[x] ^ b[y]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_odd_rows(odd, odd_rows):
    got = sorted((tuple(r) for r in simhash_dedup.simhash_dedup(odd).collect()), key=str)
    assert got == sorted(brute_components([(d, brute_print(t)) for d, t, _ in odd_rows], 2), key=str)


def test_empty(empty):
    assert simhash_dedup.simhash_dedup(empty).count() == 0
    assert simhash_dedup.drop_near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs):
    kept = {r[0] for r in simhash_dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    groups = {r["component_id"] for r in simhash_dedup.simhash_dedup(docs).collect()}
    assert kept == groups
