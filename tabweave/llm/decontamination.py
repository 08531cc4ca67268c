"""Benchmark decontamination by q-gram lemma filtering.

A passage of m bytes that occurs with at most e edits shares at least m - q + 1 - q * e
q-grams with its occurrence, all within e diagonals of each other.  The scan counts the
q-grams that a document shares with each passage in overlapping diagonal bands, retains
the bands that reach the bound, and verifies them by banded alignment.

The passages are the query set: they go out in blocks of a bounded number of q-grams, and
one scan, in one worker a task, holds the documents against several blocks, without a
shuffle.  A benchmark of over ``HELD`` blocks takes a scan for each ``HELD`` of them.
A passage of fewer than 2 q bytes gets no edit: with one, it need not share a q-gram.

Both sides are compared case-folded (ASCII and Latin-1) with runs of other ASCII signs as
one blank.  Nulls: a null or empty text or passage matches nothing; ids pass through, null
or repeated ones too.  Equal passages are all reported.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .core import keyed_docs, mix, slabs, text_bytes
from .repeats import _powers, byte_symbols, prefix_sums

Q = 12
#: Edits allowed, as a share of the passage's bytes.
EDIT_SHARE = 0.05
#: q-grams of the passages that a block holds (about 32 bytes each in a task).
BLOCK_GRAMS = 1 << 20
#: Blocks that one scan of the documents holds: at most HELD * (32 BLOCK_GRAMS + 16 MB) bytes a worker.
HELD = 4
SLAB = 1 << 18
_FILTER_BITS = 24


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their offsets by text, and the place in ``data`` that each came from."""
    if not len(data):
        return data, offsets, np.zeros(0, np.int64)
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for a, b in ((48, 57), (97, 122)):
        table[a : b + 1] = np.arange(a, b + 1)
    table[65:91] = np.arange(97, 123)
    out = table[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 0x20
    blank = out == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    keep[cuts] = ~blank[cuts]  # no blank leads a text
    source = np.flatnonzero(keep)
    return out[source], np.searchsorted(source, offsets), source


def banded_distance(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Fewest edits between ``passage`` and a substring of ``text``, over diagonals low..high, with its start and end.

    Returns (most + 1, 0, 0) if there is none within ``most``.  Row i of the band holds
    text places i + low .. i + high.
    """
    width, big = high - low + 1, 1 << 20
    place = np.arange(low, high + 1)
    cost = np.where((place >= 0) & (place <= len(text)), 0, big)
    begin = place.copy()
    steps = np.arange(width)
    for i in range(1, len(passage) + 1):
        place = np.arange(i + low, i + high + 1)
        inside = (place >= 1) & (place <= len(text))
        differs = np.where(inside, text[np.clip(place - 1, 0, max(0, len(text) - 1))] != passage[i - 1], True)
        across = np.where(inside, cost + differs, big)
        down = np.append(cost[1:], big) + 1
        best = np.where(across <= down, across, down)
        origin = np.where(across <= down, begin, np.append(begin[1:], 0))
        best = np.where((place >= 0) & (place <= len(text)), best, big)
        # moving along the text: a running minimum of best - step
        run = np.minimum.accumulate((best - steps) * width + steps)
        cost, begin = run // width + steps, origin[run % width]
        if cost.min() > most:
            return most + 1, 0, 0
    k = int(cost.argmin())
    if cost[k] > most:
        return most + 1, 0, 0
    return int(cost[k]), int(begin[k]), int(len(passage) + low + k)


class Index:
    """q-grams of a block of passages: sorted hashes, the (passage, place) lists behind them, and a bit filter."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, share: float):
        self.q, self.ids, self.texts = q, [i for i, _ in items], [t for _, t in items]
        sizes = np.array([len(t) for t in self.texts])
        # as many edits as the share allows while the lemma still asks for one shared q-gram
        self.edits = np.minimum((sizes * share).astype(int), np.maximum(0, (sizes - q) // q))
        self.need = np.maximum(1, sizes - q + 1 - q * self.edits)
        hashes, owner, place = [], [], []
        for k, t in enumerate(self.texts):
            if len(t) >= q:
                hashes.append(gram_hashes(t, q))
                owner.append(np.full(len(t) - q + 1, k))
                place.append(np.arange(len(t) - q + 1))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < q]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(text, passage, edits, start, end) of every verified region, in folded bytes."""
        q, found = self.q, []
        if len(data) >= q and len(self.hashes):
            hashes = gram_hashes(data, q)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            hit = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
            slot = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
            true = (self.hashes[slot] == hashes[hit]) & (text[hit] == text[np.minimum(hit + q - 1, len(text) - 1)])
            hit, slot = hit[true], slot[true]
            n = self.first[slot + 1] - self.first[slot]
            entry = np.repeat(self.first[slot] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            where, item = np.repeat(hit, n), self.owner[entry]
            diagonal = where - offsets[text[where]] - self.place[entry]
            width = self.edits[item] + 1
            band = diagonal // width
            # bands are two widths long and overlap by one, so all diagonals of a match share a band
            key = np.concatenate([np.stack([text[where], item, b], axis=1) for b in (band, band - 1)]) if len(where) else np.zeros((0, 3), np.int64)
            span = np.int64(len(data) + (1 << 24))
            packed, count = np.unique((key[:, 0] * len(self.texts) + key[:, 1]) * (2 * span) + key[:, 2] + span, return_counts=True)
            rest, b = packed // (2 * span), packed % (2 * span) - span
            t, k = rest // len(self.texts), rest % len(self.texts)
            good = count >= self.need[k]
            for t_, k_, b_ in zip(t[good].tolist(), k[good].tolist(), b[good].tolist()):
                own, passage = data[offsets[t_] : offsets[t_ + 1]], self.texts[k_]
                e, low = int(self.edits[k_]), b_ * (int(self.edits[k_]) + 1)
                a = max(0, low - e)
                part = own[a : low + 2 * (e + 1) + len(passage) + e]
                if (at := part.tobytes().find(passage.tobytes())) >= 0:
                    found.append((t_, k_, 0, a + at, a + at + len(passage)))
                    continue
                d, begin, end = banded_distance(passage, part, low - a - e, low - a + 2 * e + 1 + e, e)
                if d <= e:
                    found.append((t_, k_, d, a + begin, a + end))
        if self.short:
            raw = data.tobytes()
            for t_ in range(len(offsets) - 1):
                own = b" " + raw[offsets[t_] : offsets[t_ + 1]].strip() + b" "
                for k_ in self.short:
                    if (at := own.find(b" " + self.texts[k_].tobytes() + b" ")) >= 0:
                        found.append((t_, k_, 0, at, at + len(self.texts[k_])))
        best: dict[tuple[int, int], tuple] = {}
        for f in found:
            if f[:2] not in best or f[2:] < best[f[:2]][2:]:
                best[f[:2]] = f
        return list(best.values())


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    sums = prefix_sums(byte_symbols(data))
    n = len(data) - q + 1
    return mix((sums[q:] - sums[:-q]) * _powers(len(sums))[1][:n])


def passages(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of (id, folded bytes), each of a bounded number of q-grams, streamed from the query set."""
    block, size = [], 0
    for row in keyed_docs(benchmark, id_col, text_col).where("text is not null").orderBy("doc_id", "text").toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        text = normal(raw, np.array([0, len(raw)]))[0]
        text = text[:-1] if len(text) and text[-1] == 32 else text
        if not len(text):
            continue
        if block and size + len(text) > BLOCK_GRAMS:
            yield block
            block, size = [], 0
        block.append((row["doc_id"], text))
        size += len(text)
    if block:
        yield block


def _scans(spark, benchmark: DataFrame, item_col: str, item_text: str, q: int, share: float):
    """Lists of up to ``HELD`` indexes that workers hold, each a broadcast of a bounded block."""
    held = []
    for block in passages(benchmark, item_col, item_text):
        held.append(spark.sparkContext.broadcast(Index(block, q, share)))  # at most BLOCK_GRAMS bytes of passages, and their index
        if len(held) == HELD:
            yield held
            held = []
    if held:
        yield held


def _found(indexes: list, column: pa.Array):
    """(row, id, edits, start, stop) of the passages of all ``indexes`` that texts of an Arrow column hold; places in code points."""
    data, offsets = text_bytes(column)
    for lo, hi in slabs(offsets, SLAB):
        raw = data[offsets[lo] : offsets[hi]]
        folded, offs, source = normal(raw, offsets[lo : hi + 1] - offsets[lo])
        points = None
        for index in indexes:
            for t, k, d, a, b in index.value.scan(folded, offs):
                points = np.append(0, np.cumsum((raw & 0xC0) != 0x80)) if points is None else points
                head = points[offsets[lo + t] - offsets[lo]]
                yield lo + t, index.value.ids[k], d, int(points[source[offs[t] + a]] - head), int(points[source[offs[t] + b - 1] + 1] - head)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """One row a document and passage that it holds: doc_id, item_id, edits, start, stop (code points of the document)."""
    docs = keyed_docs(df, id_col, text_col)
    spark, out = df.sparkSession, None
    schema = "doc_id long, item_id long, edits int, start long, stop long"
    for held in _scans(spark, benchmark, item_col, item_text, q, share):

        def scan(batches, held=held):
            for batch in batches:
                found = list(_found(held, batch.column(1)))
                rows, items, edits, starts, stops = zip(*found) if found else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(edits, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
                    names=["doc_id", "item_id", "edits", "start", "stop"],
                )

        part = docs.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``df`` (all columns) that hold no passage.

    Rows are judged one by one in the scan, by their text alone: nothing is shuffled, and
    null or repeated ids or clashing column names change nothing.
    """
    at, spark = df.columns.index(text_col), df.sparkSession
    for held in _scans(spark, benchmark, item_col, item_text, q, share):

        def keep(batches, held=held):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _found(held, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(keep, df.schema)
    return df
