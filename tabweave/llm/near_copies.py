"""Near copies by their real word shingles: MinHash bands propose, the shingles decide.

Two texts are near copies if the Jaccard similarity of their sets of word shingles (A-Z
lowered) reaches a bound.  Texts with equal sets are one point.  Every point has a
MinHash signature, cut into bands; points that share a band are proposed, and what the
proposals connect is one family.  The shingles of a family's points travel once to a task
that compares them in full, so a link is never a guess: what stays apart there is kept.
With 32 bands of 6 a pair at the bound of 0.8 is proposed with a probability of 0.9999.

A family is compared by search from its first point: a point that is linked is not
compared with its own group again, so a group of like copies takes one sweep.  A family
with over ``SLAB`` shingles is dealt as a triangle of blocks, where each pair of blocks
meets in one task.  Boilerplate may chain much of a corpus into one family; where the
triangle would send a point more than ``BANDS`` times, the family is cut first: its points
are compared within each value of each band that they share, which sends a point once a
band at most, and only what is linked there is closed to groups.  A band's value with over
``SLAB`` shingles is a triangle of its own.

A row is known by its id and a hash of its text, so null and repeated ids are rows of
their own.  Texts without words have equal, empty sets: they are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import first_of_groups, marked, mix, settled, spread_join, text_bytes
from .simhash_dedup import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a signature, and MinHash values in a band.
BANDS, ROWS = 32, 6
#: Shingles of a family that one block holds.
SLAB = 1 << 21


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of ``text``; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, width = b" ".join(words), min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    ends = (starts + sizes)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts.tolist(), ends)], np.uint64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    odd, flip = rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
    return (odd | np.uint32(1))[:, None], flip[:, None]


def bands(hashes: np.ndarray, odd: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """One value a band: what the MinHash values of the band mix to."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(least, ((low[None, k : k + 1024] ^ flip) * odd).min(axis=1), out=least)
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mix(out ^ row) + np.uint64(0x9E3779B97F4A7C15)
    return out


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j: a tree over each group that pairs with at least this Jaccard similarity connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.append(True, np.diff(flat[order]) != 0) if len(flat) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    spans = np.diff(np.append(starts, len(flat)))
    term = np.empty(len(flat), np.int64)
    term[order] = np.cumsum(new) - 1
    owner, edges = owner[order], np.append(0, np.cumsum(sizes))
    waits, left = np.ones(len(sets), bool), len(sets)
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(len(sets)):
        if not waits[first]:
            continue
        waits[first], left, queue = False, left - 1, [first]
        while queue and left:
            x = queue.pop()
            own = term[edges[x] : edges[x + 1]]
            own = own[spans[own] > 1]
            n = spans[own]
            places = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
            common = np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(waits & (common > 0) & (common >= similarity * (sizes[x] + sizes - common) - 1e-9))
            waits[near] = False
            left -= len(near)
            queue += near.tolist()
            heads.append(np.full(len(near), first))
            tails.append(near)
    return np.concatenate(heads), np.concatenate(tails)


def prints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, mark, content (a hash of the set of shingles), size of the set and the signature's bands (keys), of every row."""

    def scan(batches):
        odd, flip = _functions()
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw, content, size, values = data.tobytes(), [], [], []
            for i in range(batch.num_rows):
                found = shingles(raw[offsets[i] : offsets[i + 1]], width)
                content.append(xxhash.xxh64_intdigest(found.tobytes()))
                size.append(len(found))
                values.append(bands(found, odd, flip))
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(size, pa.int64()), lists],
                names=["doc_id", "mark", "content", "size", "keys"],
            )

    return marked(df, id_col, text_col).mapInArrow(scan, "doc_id long, mark long, content long, size long, keys array<long>")


def proposals(points: DataFrame) -> DataFrame:
    """(a, b): every point of a band's value with the smallest one there; g points give g - 1 links."""
    held = settled(points.select("content", F.posexplode("keys").alias("band", "value")), "bands")
    heads = settled(held.groupBy("band", "value").agg(F.min("content").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    met = spread_join(held, heads, ["band", "value"], "n", F.xxhash64("content"))
    return met.where("a != content").select("a", F.col("content").alias("b")).distinct()


def links(df: DataFrame, rows: DataFrame, propose: Callable[[DataFrame], DataFrame], ways: int, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of contents, that connect what pairs of at least ``similarity`` among the proposals' families connect.

    ``rows`` have up to ``ways`` keys each; ``propose`` takes the distinct points and links some that share a key in one place.
    """
    own = [c for c in rows.columns if c not in ("doc_id", "mark", "content")]
    points = settled(rows.where("size > 0").groupBy("content").agg(*(F.first(c).alias(c) for c in own), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("row")), "points")
    family = components(propose(points)).withColumnRenamed("node", "content")
    # the smallest point of a family has no link to itself
    family = settled(family.unionByName(family.select(F.col("root").alias("content"), "root")).distinct(), "family")
    held = settled(family.hint("merge").join(points.select("content", "size", "row"), "content"), "held")
    parts = F.greatest(F.lit(1), F.ceil(F.col("weight") / F.lit(SLAB))).cast("int")
    weights = settled(held.groupBy("root").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")).withColumn("parts", parts), "weights")
    held = settled(spread_join(held, weights, ["root"], "n", F.xxhash64("content")).select("content", "size", "row", "root", "parts"), "dealt")
    # in families that are too large for a triangle, the values of keys are the groups
    large = held.where(F.col("parts") > ways)
    at = points.select("content", F.posexplode("keys").alias("band", "value")).join(large.hint("merge"), "content")
    at = settled(at.select("content", "size", "row", F.xxhash64("band", "value").alias("root")), "cut")
    values = settled(at.groupBy("root").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", parts), "values")
    at = spread_join(at, values, ["root"], "n", F.xxhash64("content")).select("content", "row", "root", "parts")
    places = held.where(F.col("parts") <= ways).select("content", "row", "root", "parts").unionByName(at)
    # at most one group, or one a key, for each point
    places = settled(places.groupBy("content").agg(F.first("row").alias("row"), F.collect_list(F.struct("root", "parts")).alias("places")), "places")
    places = places.select(F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"), "content", "places")
    docs = marked(df, id_col, text_col).join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))

    def sets(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            found = [shingles(raw[offsets[i] : offsets[i + 1]], width).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["content", "places", "hashes"])

    # rows that share id and text are one point
    dealt = docs.select("content", "places", "text").mapInArrow(sets, "content long, places array<struct<root: long, parts: int>>, hashes binary")
    dealt = dealt.select("content", "hashes", F.inline("places"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.col("root").alias("r"), F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "content", "hashes")

    def compare(batches):
        at, names, held = None, [], []
        for batch in batches:
            r, p, q, content = (batch.column(k).to_numpy() for k in range(4))
            for k in range(batch.num_rows):
                if at != (now := (r[k], p[k], q[k])):
                    yield from emit(names, held)
                    at, names, held = now, [], []
                if not names or names[-1] != content[k]:
                    names.append(content[k])
                    held.append(np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64).copy())
        yield from emit(names, held)

    def emit(names, held):
        if len(names) > 1:
            i, j = linked(held, similarity)
            names = np.array(names, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], names=["a", "b"])

    return dealt.repartition("r", "p", "q").sortWithinPartitions("r", "p", "q", "content").mapInArrow(compare, "a long, b long")


def drop_linked(df: DataFrame, rows: DataFrame, propose: Callable[[DataFrame], DataFrame], ways: int, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that come first in their group; ``rows`` (settled) and ``propose`` as in ``links``."""
    found = components(links(df, rows, propose, ways, id_col, text_col, shingle, similarity))
    named = rows.select("doc_id", "mark", "content").join(found.hint("merge"), F.col("content") == F.col("node"), "left").select("doc_id", "mark", F.coalesce("root", "content").alias("root"))
    return first_of_groups(df, settled(named, "named"), id_col, text_col)


def drop_near_copies(df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) that come first, by id (null last), in their group of near copies: one row a group."""
    rows = settled(prints(df, id_col, text_col, shingle), "prints")
    return drop_linked(df, rows, proposals, BANDS, shingle, similarity, id_col, text_col)
