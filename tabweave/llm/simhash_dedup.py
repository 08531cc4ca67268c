"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint has a row in a table of Hamming distances to many reference
fingerprints (pivots).  Of the references one is zero and 32 are pairs of neighbouring
bits; the difference of the distances to a pair and to zero is a coordinate with three
values, and a differing bit moves one coordinate only.  So fingerprints within the radius
agree on all coordinates but ``radius``: the coordinates fall into ``radius`` + 3 sections,
and points are dealt to cells by each choice of three sections, one of which a near pair
shares.  In a cell, pairs are discarded whose distances to any further pivot (the triangle
inequality allows the radius at most) differ by more, comparing table rows only; survivors
are verified bit by bit.  Large cells are cut again along pivot distances and dealt in
blocks, so no task holds a whole large cell.

Only distinct fingerprints are joined; equal ones are one point.  Components come from
star contraction over the links, in rounds whose state is a table in the shared folder.

Nulls: a null text has no words and fingerprint zero, linked like any other; a row with
null id takes part but is nobody's component id unless its component has only such rows.
Repeated ids are rows of their own.  An empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import first_of_groups, marked, mix, settled, spread_join, text_bytes

BITS = 64
#: Further references, whose distances discard pairs within a cell.
PIVOTS = 24
#: Rows of a cell that one task compares; a larger cell is cut along pivot distances.
CELL = 512


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text`` (A-Z lowered): a bit is set if it is in over half the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    ends = (starts + sizes)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends)], dtype=">u8")
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            found = [fingerprint(raw[offsets[i] : offsets[i + 1]], shingle) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "mark", "fp"])

    return marked(df, id_col, text_col).mapInArrow(scan, "doc_id long, mark long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: alternating halves of the bits at growing grain, then random ones."""
    rng = np.random.default_rng(5)
    fixed = [sum(1 << b for b in range(BITS) if (b >> k) & 1) for k in range(6)]
    return np.array(fixed + rng.integers(0, 1 << 63, max(0, count - len(fixed)), dtype=np.uint64).tolist(), np.uint64)[:count]


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference: one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def near_pairs(left: np.ndarray, right: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with Hamming distance up to ``radius``, by pivot filter, then verification.

    The right side is sorted by its first coordinate, so each row of the left meets only
    rows within the radius there; the other coordinates are compared next.
    """
    ta, tb = pivot_table(left, refs), pivot_table(right, refs)
    order = np.argsort(tb[:, 0], kind="stable")
    tb, rb = tb[order], right[order]
    lo = np.searchsorted(tb[:, 0], ta[:, 0] - radius, side="left")
    hi = np.searchsorted(tb[:, 0], ta[:, 0] + radius, side="right")
    found_i, found_j = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        n = (hi - lo)[a : a + step]
        i = np.repeat(np.arange(a, min(a + step, len(left))), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a : a + step], n)
        for c in range(1, ta.shape[1]):
            if not len(i):
                break
            keep = np.abs(ta[i, c] - tb[j, c]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(left[i] ^ rb[j]) <= radius
        found_i.append(i[keep])
        found_j.append(order[j[keep]])
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])


def pair_references() -> np.ndarray:
    """Zero, then the 32 pairs of neighbouring bits."""
    return np.array([0, *(3 << 2 * k for k in range(BITS // 2))], np.uint64)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Of each fingerprint 32 coordinates from its row of the distance table: 0, 1 or 2."""
    table = pivot_table(fps, pair_references())
    return (table[:, :1] + np.int8(2) - table[:, 1:]) >> 1


def cells_of(fps: np.ndarray, radius: int) -> np.ndarray:
    """The cells of each fingerprint, one for each choice of three of ``radius`` + 3 sections of its coordinates."""
    place = coordinates(fps).astype(np.uint64)
    ends = [place.shape[1] * k // (radius + 3) for k in range(radius + 4)]
    power = np.uint64(3) ** np.arange(place.shape[1], dtype=np.uint64)
    section = [(place[:, a:z] * power[: z - a]).sum(axis=1, dtype=np.uint64) for a, z in zip(ends, ends[1:])]
    out = []
    for k, (a, b, c) in enumerate(combinations(range(radius + 3), 3)):
        out.append(mix(mix(mix(section[a] + np.uint64(k << 48)) ^ section[b]) ^ section[c]))
    return np.stack(out, axis=1) if out else np.zeros((len(fps), 0), np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def distance_to(fp: Column, ref: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(ref)).cast("long")))


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect what all pairs within ``radius`` connect.

    ``points`` has one row a distinct fingerprint (fp).  Each cell gives its pairs as
    links to the smallest fingerprint that reaches them within that piece of the cell, so a
    cell of g points gives fewer than g links.
    """
    refs = pivots()

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 8192):
                part = fps[lo : lo + 8192]
                cells = cells_of(part.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, cells.shape[1])), pa.array(cells.ravel().view(np.int64))], names=["fp", "v"])

    cells = settled(points.select("fp").mapInArrow(deal, "fp long, v long"), "cells")
    sizes = cells.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = cells.join(sizes.hint("merge"), "v")
    # a large cell is cut along two pivot coordinates; a row also visits the slices within the radius of its own
    width = 2 * radius + 2

    def around(ref: int):
        d = distance_to(F.col("fp"), ref)
        lo, hi = F.floor((d - radius) / F.lit(width)), F.floor((d + radius) / F.lit(width))
        return F.when(F.col("size") > CELL, F.sequence(lo, hi)).otherwise(F.array(F.lit(0).cast("long")))

    cut = held.withColumn("s", F.explode(around(int(refs[-1])))).withColumn("t", F.explode(around(int(refs[-2]))))
    # what remains large is dealt as a triangle of blocks: each pair of blocks meets in one task
    cut = settled(cut, "cut")
    per = cut.groupBy("v", "s", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(CELL))).cast("int")
    dealt = cut.join(per.hint("merge"), ["v", "s", "t"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("o", other).select(
        "fp", F.xxhash64("v", "s", "t", F.least("part", "o"), F.greatest("part", "o")).alias("cell")
    )

    def compare(batches):
        fps, cell = [], []
        for batch in batches:
            f, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            fps.append(f)
            cell.append(c)
            edges = np.flatnonzero(np.diff(c)) + 1
            if len(edges):
                yield emit(np.concatenate([*fps[:-1], f[: edges[-1]]]), np.concatenate([*cell[:-1], c[: edges[-1]]]))
                fps, cell = [f[edges[-1] :]], [c[edges[-1] :]]
        if fps:
            yield emit(np.concatenate(fps), np.concatenate(cell))

    def emit(fps, cell):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        sizes = np.diff(edges)
        heads, tails = [], []
        two = edges[:-1][sizes == 2]
        # cells of two, all at once: discard by table rows, then verify what survives
        two = two[(np.abs(pivot_table(fps[two], refs) - pivot_table(fps[two + 1], refs)).max(axis=1, initial=0) <= radius)]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
        heads.append(fps[two][near])
        tails.append(fps[two + 1][near])
        for lo in edges[:-1][sizes > 2]:
            own = np.unique(fps[lo : edges[np.searchsorted(edges, lo) + 1]])
            i, j = near_pairs(own, own, refs, radius)
            root = roots(len(own), i, j)
            moved = root != np.arange(len(own))
            heads.append(own[root[moved]])
            tails.append(own[moved])
        a, b = np.concatenate(heads), np.concatenate(tails)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")
    return found.where("a != b").distinct()


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, by minimum label with pointer jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with a link.

    Alternates large-star and small-star: every node points its larger (then smaller)
    neighbours to the smallest it knows.  Each round's links are a table in the shared
    folder; work stops when a round changes nothing.
    """
    now = settled(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x != y").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.select("x", "y").unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # the minima are tables of their own: both sides of the joins are plain shuffles, whose large partitions Spark splits
        least = settled(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "x").where("y > x").select(F.col("m").alias("x"), "y").where("x != y").distinct()
        large = settled(large, "large")
        low = settled(large.groupBy("y").agg(F.min("x").alias("m")), "low")
        small = large.join(low.hint("merge"), "y")
        new = small.select(F.col("m").alias("x"), "y").unionByName(small.where("x != m").select(F.col("m").alias("x"), F.col("x").alias("y"))).distinct()
        now = settled(new, "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("y").alias("node"), F.col("x").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _linked(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint: its smallest id, and the smallest fingerprint that it reaches."""
    points = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "points")
    linked = components(links(points, radius))
    return points.join(linked.hint("merge"), points["fp"] == linked["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def simhash_dedup(df: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links of up to ``radius`` bits."""
    prints = settled(fingerprints(df, shingle, id_col, text_col).drop("mark"), "prints")
    named = settled(_linked(prints, radius), "named")
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = settled(named.join(group.hint("merge"), "root").select("fp", "component_id", "n"), "classes")
    return spread_join(prints, table, ["fp"], "n", F.xxhash64("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (all columns) of each component: the first by id (null last), then by a hash of the text.

    Rows are told apart by id and text, so those with a null or repeated id stay or go by
    their own text; rows that share both are copies, of which one stays.
    """
    prints = settled(fingerprints(df, shingle, id_col, text_col), "prints")
    table = settled(_linked(prints, radius).select("fp", "root", "n"), "classes")
    named = settled(spread_join(prints, table, ["fp"], "n", F.xxhash64("doc_id", "mark")).select("doc_id", "mark", "root"), "named")
    return first_of_groups(df, named, id_col, text_col)
