"""Near copies by SimHash: fingerprints and pivot distance tables propose, the shingles decide.

Two texts are near copies if the Jaccard similarity of their sets of word shingles
reaches a bound, as in ``near_copies``.  Every distinct set has ``DIMS`` signed totals, one a bit:
shingles with the bit less shingles without it.  Their signs are the SimHash; the
first ``PRINT`` of them are the fingerprint.  At a similarity of 0.8 a bit differs with a
probability of 0.15 (0.19 for sets of four and five), so fingerprints differ by some 29 to 36
of 192 bits, while those of unlike texts differ by 96; ``RADIUS`` is 56.

Pivots deal the points to cells.  The references of a group of ``GROUP`` bits are its axes, both ways;
the nearest one is the axis of the largest total, the bit that most shingles agree on.  A cell
is the nearest reference in each of two groups; every point has one in each of ``TABLES``
tables.  In a cell, ``PIVOTS`` of its own points are references of a distance table: pairs are discarded
whose distances to one of them differ by more than the radius (triangle inequality),
survivors are verified bit by bit, and what is within the radius is proposed.  A cell is hot if it
holds over ``CELL`` points and one of ``HOT`` of all points; there all are proposed without a
comparison, which costs more comparisons of shingles and loses nothing.

Families of proposals are compared by their real shingles in ``near_copies.links``, so a link is
never a guess.  That a pair at the bound shares a cell is a chance (over 0.999), not a proof.
Sets of which no other set can come near enough (under four shingles at 0.8) propose nothing.

Nulls, repeated ids and empty tables are as in ``near_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import marked, mix, settled, text_bytes
from .near_copies import SHINGLE, SIMILARITY, drop_linked, shingles
from .simhash_dedup import roots

#: Bits of the whole SimHash, and of the fingerprint that is compared.
DIMS, PRINT = 1024, 192
#: Differing bits of fingerprints that are proposed.
RADIUS = 56
#: Tables, and bits of a group: a cell is a pair of groups' nearest references.
TABLES, GROUP = 64, 64
#: Points of a cell that are references of its distance table.
PIVOTS = 4
#: A cell with more points than ``CELL`` that also holds one of ``HOT`` points is hot.
CELL, HOT = 1024, 1000
#: Pairs that are compared at once.
STEP = 1 << 20


def totals(hashes: np.ndarray) -> np.ndarray:
    """Of each bit: how many of ``hashes`` have it, less how many do not."""
    salts = np.arange(1, DIMS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.zeros(DIMS, np.int32)
    # blocks whose bits stay in a processor's cache, and whose counts fit a byte
    for k in range(0, len(hashes), 32):
        words = mix(hashes[k : k + 32, None] + salts)
        count += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * count - len(hashes)


def groups() -> np.ndarray:
    """The bits of each group, two groups a table: shuffles of all bits, cut into groups."""
    rng = np.random.default_rng(7)
    need = -(-2 * TABLES * GROUP // DIMS)
    return np.concatenate([rng.permutation(DIMS) for _ in range(need)])[: 2 * TABLES * GROUP].reshape(2 * TABLES, GROUP)


def cells(total: np.ndarray, dealt: np.ndarray) -> np.ndarray:
    """One cell a table: the table's number and the nearest references in its two groups."""
    own = total[dealt]
    axis = np.abs(own).argmax(axis=1)
    nearest = (2 * axis + (own[np.arange(len(own)), axis] > 0)).reshape(TABLES, 2)
    return ((np.arange(TABLES) * 2 * GROUP + nearest[:, 0]) * 2 * GROUP + nearest[:, 1]).astype(np.int32)


def prints(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """doc_id, mark, content (a hash of the set of shingles), size of the set, its cells (keys) and fingerprint (f0 to f2), of every row."""
    words = PRINT // 64

    def scan(batches):
        dealt = groups()
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw, n = data.tobytes(), batch.num_rows
            content, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
            fp, keys = np.zeros((n, words), np.uint64), []
            for i in range(n):
                found = shingles(raw[offsets[i] : offsets[i + 1]], width)
                content[i], size[i] = xxhash.xxh64_intdigest(found.tobytes()), len(found)
                # the nearest that another set can come is one shingle more
                if len(found) < similarity * (len(found) + 1) - 1e-9:
                    keys.append(np.zeros(0, np.int32))
                    continue
                total = totals(found)
                fp[i] = np.packbits(total[:PRINT] > 0).view(np.uint64)
                keys.append(cells(total, dealt))
            edges = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*keys, np.zeros(0, np.int32)])))
            columns = [pa.array(c) for c in (content.view(np.int64), size, *np.ascontiguousarray(fp.T).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns[:2], lists, *columns[2:]], names=["doc_id", "mark", "content", "size", "keys", *(f"f{k}" for k in range(words))])

    named = ", ".join(f"f{k} long" for k in range(words))
    return marked(df, id_col, text_col).mapInArrow(scan, f"doc_id long, mark long, content long, size long, keys array<int>, {named}")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def near_pairs(fps: np.ndarray, edges: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (i, j), i < j, of one cell with distance up to ``radius``, and how many pairs the table discarded.

    ``edges`` are the cells' first places and the end.
    """
    sizes = np.diff(edges)
    first, size = np.repeat(edges[:-1], sizes), np.repeat(sizes, sizes)
    table = [distance(fps, fps[first + size * k // PIVOTS]) for k in range(PIVOTS)]
    later = first + size - 1 - np.arange(len(fps))
    ends = np.cumsum(later)
    heads, tails, gone, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    while lo < len(fps):
        # one row's pairs at least, else as many rows as stay below the step
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        n = later[lo:hi]
        i = np.repeat(np.arange(lo, lo + len(n)), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        met = len(i)
        for t in table:
            keep = np.abs(t[i] - t[j]) <= radius
            if not keep.all():
                i, j = i[keep], j[keep]
        gone += met - len(i)
        far = np.zeros(len(i), np.int16)
        for k in range(fps.shape[1]):
            far += np.bitwise_count(fps[i, k] ^ fps[j, k])
            keep = far <= radius
            if not keep.all():
                i, j, far = i[keep], j[keep], far[keep]
        heads.append(i)
        tails.append(j)
        lo = hi
    return np.concatenate(heads), np.concatenate(tails), gone


def proposals(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect what pairs of one cell within ``radius`` connect, and all of a hot cell."""
    names = [c for c in points.columns if c[0] == "f" and c[1:].isdigit()]
    held = points.select("content", *names, F.explode("keys").alias("cell"))
    total = points.count()
    hot = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > CELL) & (F.col("n") * HOT > total))
    # at most HOT cells a table
    hot = settled(hot.select("cell"), "hot")
    crowd = held.join(F.broadcast(hot), "cell").select("cell", "content")
    least = settled(crowd.groupBy("cell").agg(F.min("content").alias("a")), "least")
    whole = crowd.join(F.broadcast(least), "cell").select("a", F.col("content").alias("b"))

    def compare(batches):
        fps, content, cell = [], [], []
        for batch in batches:
            c = batch.column(0).to_numpy()
            cut = int(np.searchsorted(c, c[-1])) if len(c) else 0
            content.append(batch.column(1).to_numpy())
            fps.append(np.stack([batch.column(2 + k).to_numpy().view(np.uint64) for k in range(len(names))], axis=1))
            cell.append(c)
            if cut:
                # all cells but the last are whole
                f, d, c = np.concatenate(fps), np.concatenate(content), np.concatenate(cell)
                cut += len(c) - batch.num_rows
                yield emit(f[:cut], d[:cut], c[:cut])
                fps, content, cell = [f[cut:]], [d[cut:]], [c[cut:]]
        if cell:
            yield emit(np.concatenate(fps), np.concatenate(content), np.concatenate(cell))

    def emit(fps, content, cell):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
        i, j, _ = near_pairs(fps, edges, radius)
        root = roots(len(fps), i, j)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(content[root[moved]]), pa.array(content[moved])], names=["a", "b"])

    cold = held.join(F.broadcast(hot), "cell", "left_anti").select("cell", "content", *names)
    near = cold.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")
    return near.unionByName(whole).where("a != b").distinct()


def drop_near_copies(df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) that come first, by id (null last), in their group of near copies: one row a group."""
    rows = settled(prints(df, id_col, text_col, shingle, similarity), "prints")
    return drop_linked(df, rows, lambda points: proposals(points, radius), TABLES, shingle, similarity, id_col, text_col)
