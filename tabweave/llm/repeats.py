"""Repeated fixed-length windows over a corpus, found without shuffling every window.

A window is ``n`` consecutive symbols (bytes or words) of one document.  Every window has
an *anchor*: its smallest hashed ``gram``-symbol piece, leftmost on ties.  Neighbouring
windows mostly share their anchor, so a document falls into *runs* of windows with one
anchor; a run is one row.  Two equal windows have equal anchors at equal offsets, hence:

* runs with equal contents hold equal windows, one by one;
* a window of a run can only equal windows of other runs with the same anchor.

So counting anchors first discards the runs that share nothing (nearly all), and only
runs whose anchor has several different contents need a look at single windows.
All hashing is Rabin-Karp (polynomial, modulo 2**64, over random symbol values).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import NAME, mix, settled, slabs, spread_join, text_bytes

BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols worked on at once; longer documents are cut into overlapping pieces.
SLAB = 1 << 18
RUN_SCHEMA = "tag int, doc_id long, at long, anchor long, content long"
#: ``at`` packs a run as start * 2**LEN_BITS + length * 2 + (1 if the first of its content in its document).
LEN_BITS = 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown on demand and kept per worker."""
    have = _powers.__dict__.get("table")
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers.__dict__["table"] = have
    return have


def prefix_sums(sym: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * _powers(len(sym) + 1)[0][: len(sym)], out=out[1:])
    return out


def piece_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of sym[start:end], the same wherever the piece stands."""
    return (sums[end] - sums[start]) * _powers(len(sums))[1][start]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    table = _powers.__dict__.get("bytes")
    if table is None:
        table = _powers.__dict__["bytes"] = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts, and each text's first word number (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = (data != 32) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(piece_hash(prefix_sums(byte_symbols(data)), starts, ends) + (ends - starts).astype(np.uint64))


def symbols_of(unit: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From bytes and text offsets to hashed symbols and symbol offsets."""

    def by_byte(data, offsets):
        return byte_symbols(data), offsets

    def by_word(data, offsets):
        starts, ends, firsts = word_bounds(data, offsets)
        return word_symbols(data, starts, ends), firsts

    return {"byte": by_byte, "word": by_word}[unit]


def find_runs(sym: np.ndarray, offsets: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of all windows that lie within one text: text number, start in the text, windows, anchor, content."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(sym) < n:
        return none
    sums, width = prefix_sums(sym), n - gram + 1
    at = np.arange(len(sym) - gram + 1)
    bits = np.uint64(max(8, int(len(sym)).bit_length()))
    key = (mix((sums[gram:] - sums[:-gram]) * _powers(len(sums))[1][: len(at)]) >> bits << bits) | at.astype(np.uint64)
    full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    left = np.minimum.accumulate(full.reshape(-1, width), axis=1).ravel()
    right = np.minimum.accumulate(full.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(sym) - n + 1
    least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = text[:windows] == text[n - 1 :]
    start = good.copy()
    start[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (text[1:windows] != text[: windows - 1])
    begin = np.flatnonzero(start)
    if not len(begin):
        return none
    stop = np.minimum(np.append(begin[1:], windows), np.maximum(offsets[text[begin] + 1] - n + 1, 0))
    anchor = mix(piece_hash(sums, (a := (least[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)), a + gram))
    content = mix(piece_hash(sums, begin, stop - 1 + n) + (stop - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return text[begin], begin - offsets[text[begin]], stop - begin, anchor, content


def text_runs(data: np.ndarray, offsets: np.ndarray, unit: str, n: int, gram: int):
    """``find_runs`` over slabs of whole texts; a text beyond a slab is cut into pieces that overlap by n - 1 symbols."""
    symbols, parts = symbols_of(unit), []
    for lo, hi in slabs(offsets, SLAB):
        sym, offs = symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for a in range(0, max(1, len(sym) - n + 1), SLAB * 2) if hi - lo == 1 else (0,):
            piece = sym[a : a + SLAB * 2 + n - 1] if hi - lo == 1 else sym
            text, start, count, anchor, content = find_runs(piece, np.array([0, len(piece)]) if hi - lo == 1 else offs, n, gram)
            parts.append((text + lo, start + a, count, anchor, content))
    if not parts:
        return find_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), n, gram)
    return tuple(np.concatenate(x) for x in zip(*parts))


def runs(docs: DataFrame, unit: str, n: int, gram: int) -> DataFrame:
    """One row a run of windows of ``docs`` (tag, doc_id, text)."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            text, start, count, anchor, content = text_runs(data, offsets, unit, n, gram)
            order = np.lexsort((start, content, anchor, text))
            first = np.ones(len(order), bool)
            if len(order) > 1:
                a, b = order[1:], order[:-1]
                first[1:] = (text[a] != text[b]) | (anchor[a] != anchor[b]) | (content[a] != content[b])
            head = np.empty(len(order), np.int64)
            head[order] = first
            at = (start << LEN_BITS) | (count << 1) | head
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(at), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                names=["tag", "doc_id", "at", "anchor", "content"],
            )

    return docs.mapInArrow(scan, RUN_SCHEMA)


def shared_runs(docs: DataFrame, unit: str, n: int, gram: int) -> DataFrame:
    """The runs that another may share a window with, settled: NAME, at, anchor, content, and of that content copies, kinds, lead.

    ``copies`` is how many runs have the content, ``kinds`` how many contents the anchor
    has; a run is kept if either is over one.  ``lead`` says that the run is the first of
    its content: its document comes first, and it comes first there.

    The first pass moves only anchors and their counts, combined before the shuffle; the
    second is an equi-join on the anchor, in which common anchors are spread.
    """
    anchors = settled(runs(docs, unit, n, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchors")
    shared = settled(spread_join(runs(docs, unit, n, gram), anchors, ["anchor"], "c", F.xxhash64("doc_id", "at")).drop("c"), f"runs-{unit}{n}")
    per = settled(shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), *first_doc()), "copies")
    kinds = settled(per.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    known = settled(spread_join(per, kinds, ["anchor"], "kinds", F.col("content")), "contents")
    told = spread_join(shared, known, ["anchor", "content"], "copies", F.xxhash64("doc_id", "at"))
    lead = is_first() & (F.col("at").bitwiseAND(1) == 1)
    return settled(told.where("copies > 1 or kinds > 1").select(*NAME, "at", "anchor", "content", "copies", "kinds", lead.alias("lead")), "shared")


def first_doc() -> list[Column]:
    """Aggregates for the first document of a group: by id, those without one last (longs only, so that Spark can hash)."""
    return [F.min(F.when(F.col("tag") % 2 == 0, F.col("doc_id"))).alias("first_id"), F.min(F.when(F.col("tag") % 2 == 1, F.col("doc_id"))).alias("first_none")]


def is_first() -> Column:
    """Whether a row is of the first document, as ``first_doc`` has it."""
    return F.when(F.col("first_id").isNotNull(), (F.col("tag") % 2 == 0) & (F.col("doc_id") == F.col("first_id"))).otherwise((F.col("tag") % 2 == 1) & (F.col("doc_id") == F.col("first_none")))


def start_of(at: str = "at"):
    return F.shiftright(F.col(at), LEN_BITS)


def count_of(at: str = "at"):
    return F.shiftright(F.col(at).bitwiseAND((1 << LEN_BITS) - 1), 1)


def spans_by_doc(spans: DataFrame, name: str) -> DataFrame:
    """(tag, doc_id, start, stop) rows to one array of (start, stop) structs a document; a document's spans are bounded by its length."""
    return spans.groupBy(*NAME).agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("stop").cast("int"))).alias(name))


def covered(lists, size: int) -> np.ndarray:
    """Mask of the places below ``size`` that lie in one of the (start, stop) arrays (what lies beyond is left out)."""
    start, stop = (np.minimum(x, size) for x in lists)
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, stop, -1)
    return np.cumsum(step[:size]) > 0


def span_arrays(col: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    s = col[row]
    v = s.values if s.is_valid else None
    if v is None or not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return v.field(0).to_numpy(zero_copy_only=False).astype(np.int64), v.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def span_count(mask: np.ndarray) -> int:
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0


def by_name(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on what names a document (never null, see ``identified_docs``)."""
    return left.join(right, NAME, how)
