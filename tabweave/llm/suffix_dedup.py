"""Suffix-array dedup: repeated byte strings, found by two-stage suffix sorting.

Documents fall into runs of windows (see ``repeats``).  Runs with equal contents repeat as
a whole, and one of them stands for all.  Where an anchor has several contents, these meet
in one task, which sorts the suffixes of their texts in two stages: suffixes smaller than
their successors (type B) are sorted directly, the others (type A) are induced by one scan
of the buckets.  Common prefixes of neighbours in that order then tell which windows repeat.

A group of more than ``GROUP`` contents (one passage in very many surroundings) is divided
before it is sorted, at every size alike: its runs are cut into blocks of neighbouring
windows, and blocks go together whose windows have the same bytes in common (the core),
which equal windows have.  Blocks shrink until each group can be sorted in one task; at a
single window the core is the window, and the group is one content.

Nulls: a null text is empty; rows are told apart by id and text, so those with a null or
repeated id are documents of their own, and rows equal in both are copies.  Texts shorter
than a window are kept whole.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NAME, identified_docs, mix, real_id, settled, slabs, spread_join, text_bytes
from .repeats import by_name, byte_symbols, count_of, covered, first_doc, is_first, piece_hash, prefix_sums, shared_runs, span_arrays, span_count, spans_by_doc, start_of

GRAM = 128
#: Different contents that one task sorts together; a larger group is divided first.
GROUP = 256
#: Bytes that one suffix array spans.
BLOCK = 1 << 18
#: No UTF-8 text holds this byte: it ends each text of a block.
END = 0xFF


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the suffix one place on (the last is not: its successor is empty)."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    differs = np.empty(n, bool)
    differs[:-1], differs[-1] = text[:-1] != text[1:], True
    where = np.flatnonzero(differs)
    decided = np.repeat(where, np.diff(np.append(-1, where)))
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    return up[decided]


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Order of all suffixes of ``text``, exact to at least ``depth`` bytes (suffixes equal so far stand together).

    Stage one sorts the suffixes that are smaller than their successors; stage two
    induces the rest: a scan over the buckets by first byte puts suffix j - 1 at the
    front of its bucket when suffix j is met.
    """
    arr = np.frombuffer(text, np.uint8)
    n = len(arr)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(arr)
    direct = np.flatnonzero(small).tolist()
    pieces = [text[i : i + depth] for i in direct]
    order = sorted(range(len(direct)), key=pieces.__getitem__)
    heads = np.append(0, np.cumsum(np.bincount(arr, minlength=256)))
    out = np.full(n, -1, np.int64)
    b = np.asarray(direct, np.int64)[order]
    if len(b):
        first = arr[b]
        counts = np.bincount(first, minlength=256)
        # within a bucket the type A suffixes precede all of type B
        out[np.repeat(heads[1:] - counts, counts) + np.arange(len(b)) - np.repeat(np.cumsum(counts) - counts, counts)] = b
    sa, front, large = out.tolist(), heads[:-1].tolist(), (~small).tolist()
    last = text[n - 1]
    sa[front[last]] = n - 1
    front[last] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and large[j]:
            c = text[j]
            sa[front[c]] = j
            front[c] += 1
    return np.asarray(sa, np.int64)


def shares_prefix(text: bytes, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have a common prefix of ``n`` bytes, compared eight bytes a step."""
    pad = np.frombuffer(text + b"\0" * (n + 8), np.uint8)
    eight = np.zeros(len(pad) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | pad[k : len(pad) - 7 + k].astype(np.uint64)
    live = np.arange(len(a))
    for step in [*range(0, n - 7, 8), *([n - 8] if n % 8 and n >= 8 else [])]:
        if not len(live):
            break
        live = live[eight[a[live] + step] == eight[b[live] + step]]
    if n < 8:
        keep = np.uint64((8 - n) * 8)
        live = live[(eight[a[live]] >> keep) == (eight[b[live]] >> keep)]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def promising(texts: list[bytes], n: int) -> list[tuple[int, int, bytes]]:
    """(text, start, piece): the stretches of ``texts`` whose ``n``-byte strings may start twice.

    The middle half of a string that starts twice stands twice too: strings are left out
    whose middle does not, by hash.
    """
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    middle, out = n // 2, []
    starts = [np.arange(e - len(t), e - n + 1) for t, e in zip(texts, ends) if len(t) >= n]
    if not starts:
        return out
    at = np.concatenate(starts)
    sums = prefix_sums(byte_symbols(data))
    _, which, count = np.unique(mix(piece_hash(sums, at + n // 4, at + n // 4 + middle)), return_inverse=True, return_counts=True)
    held = at[count[which] > 1]
    if not len(held):
        return out
    owner = np.searchsorted(ends, held, side="right")
    cut = np.flatnonzero((np.diff(held) > 1) | (np.diff(owner) > 0))
    for a, b in zip(held[np.append(0, cut + 1)].tolist(), held[np.append(cut, len(held) - 1)].tolist()):
        k = int(np.searchsorted(ends, a, side="right"))
        a, b = a - int(ends[k]) + len(texts[k]), b - int(ends[k]) + len(texts[k])
        out.append((k, a, texts[k][a : b + n]))
    return out


def repeated_starts(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text, the starts of its ``n``-byte strings that start at two places of ``texts`` at least."""
    block = b"".join(t + bytes([END]) for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    sa = suffix_array(block, n + 8)
    room = np.repeat(ends - 1, [len(t) + 1 for t in texts])[sa] - sa
    whole = sa[room >= n]
    hit = np.zeros(len(block), bool)
    if len(whole) > 1:
        same = shares_prefix(block, whole[:-1], whole[1:], n)
        hit[whole[:-1][same]] = True
        hit[whole[1:][same]] = True
    return [np.flatnonzero(hit[e - len(t) - 1 : e]) for t, e in zip(texts, ends)]


PIECE = "tag int, doc_id long, start long, anchor long, place long, piece binary"


def _pieces(docs_runs: DataFrame, n: int) -> DataFrame:
    """From (tag, doc_id, text, open) to one row a wanted run with its bytes: NAME, start, anchor, its place in the run, piece, kinds."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw, rows, starts, anchors, places, pieces, kinds = data.tobytes(), [], [], [], [], [], []
            for row in range(batch.num_rows):
                v = batch.column(3)[row].values
                for at, anchor, kind in zip(*(v.field(k).to_pylist() for k in range(3))):
                    a = at >> 16
                    if a + ((at & 0xFFFF) >> 1) - 1 + n > offsets[row + 1] - offsets[row]:
                        continue
                    rows.append(row)
                    starts.append(a)
                    anchors.append(anchor)
                    kinds.append(kind)
                    lo = int(offsets[row]) + a
                    hi = lo + ((at & 0xFFFF) >> 1) - 1 + n
                    sums, inside = prefix_sums(byte_symbols(data[lo:hi])), np.arange(hi - lo - GRAM + 1)
                    places.append(int((mix(piece_hash(sums, inside, inside + GRAM)).view(np.int64) == anchor).argmax()))
                    pieces.append(raw[lo:hi])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (starts, anchors, places)), pa.array(pieces, pa.binary()), pa.array(kinds, pa.int64())],
                names=["tag", "doc_id", "start", "anchor", "place", "piece", "kinds"],
            )

    return docs_runs.mapInArrow(scan, f"{PIECE}, kinds long")


def _sorted_repeats(pieces: DataFrame, n: int) -> DataFrame:
    """(tag, doc_id, start, stop) of the repeated windows of ``pieces``; the rows of a group (anchor, core) meet in one task, GROUP at most."""

    def flush(held):
        tags, rows, starts, stops = [], [], [], []
        pieces = promising([h[-1] for h in held], n)
        for (k, inside, _), hit in zip(pieces, repeated_starts([p for _, _, p in pieces], n)):
            if len(hit):
                tag, doc, start = held[k][0], held[k][1], held[k][2] + inside
                cut = np.flatnonzero(np.diff(hit) > 1)
                a, b = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
                tags += [tag] * len(a)
                rows += [doc] * len(a)
                starts += (a + start).tolist()
                stops += (b + start + n).tolist()
        return pa.RecordBatch.from_arrays([pa.array(tags, pa.int32()), *(pa.array(x, pa.int64()) for x in (rows, starts, stops))], names=["tag", "doc_id", "start", "stop"])

    def sort(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size >= BLOCK and row[3:5] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
                last = row[3:5]
        yield flush(held)

    rows = pieces.select(*NAME, "start", "anchor", "core", "piece")
    return rows.repartition("anchor", "core").sortWithinPartitions("anchor", "core").mapInArrow(sort, "tag int, doc_id long, start long, stop long")


#: Windows a block, by division; the last is a single window, whose core is all of it.
BLOCKS = (64, 16, 4, 1)


def _blocks(pieces: DataFrame, n: int, size: int) -> DataFrame:
    """Cut runs (NAME, start, anchor, place, piece) into blocks of ``size`` windows by distance from the anchor.

    ``place`` is where the anchor stands in the piece.  Adds core (a hash of the distance
    and of the bytes that all windows of the whole block hold) and content (of the piece itself).
    """
    reach = n - GRAM

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(5))
            start, place = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            windows = np.diff(offsets) - n + 1
            # window w of a piece stands at distance u = w - place + reach >= 0
            low, high = reach - place, reach - place + windows - 1
            number = high // size - low // size + 1
            row = np.repeat(np.arange(len(windows)), number)
            block = low[row] // size + np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(number)[:-1]), number)
            first = np.maximum(block * size, low[row]) - low[row]
            last = np.minimum(block * size + size - 1, high[row]) - low[row]
            sums, at = prefix_sums(byte_symbols(data)), offsets[row]
            a, b = block * size + size - 1 - low[row], block * size - low[row] + n
            core = mix(piece_hash(sums, at + np.minimum(a, b), at + b) + block.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            content = mix(piece_hash(sums, at + first, at + last + n) + (last - first).astype(np.uint64) + (first + low[row]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            raw, ids = data.tobytes(), pa.array(row)
            cut = [raw[x:y] for x, y in zip((at + first).tolist(), (at + last + n).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(start[row] + first), batch.column(3).take(ids), pa.array(place[row] - first), pa.array(cut, pa.binary()), pa.array(core.view(np.int64)), pa.array(content.view(np.int64))],
                names=["tag", "doc_id", "start", "anchor", "place", "piece", "core", "content"],
            )

    return pieces.mapInArrow(scan, f"{PIECE}, core long, content long")


def _divided(pieces: DataFrame, n: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Divide pieces of large groups: what repeats as whole blocks (tag, doc_id, start, stop), and pieces in groups that can be sorted."""
    whole, groups = None, []
    for size in BLOCKS:
        if pieces.isEmpty():
            break
        cut = settled(_blocks(pieces, n, size), "blocks")
        key = ["anchor", "core"]
        per = settled(cut.groupBy(*key, "content").agg(F.count(F.lit(1)).alias("copies"), *first_doc()), "per")
        kinds = settled(per.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds")), "kinds")
        per = settled(spread_join(per, kinds, key, "kinds", F.col("content")).where("copies > 1 or kinds > 1"), "open")
        told = settled(spread_join(cut, per, [*key, "content"], "copies", F.xxhash64("doc_id", "start")), "told")
        again = told.where("copies > 1").select(*NAME, "start", (F.col("start") + F.length("piece")).alias("stop"))
        whole = again if whole is None else whole.unionByName(again)
        # what repeats as a whole stays in the group as the copies of one document, for others to be compared with
        left = told.where("kinds > 1").where((F.col("copies") == 1) | is_first())
        groups.append(left.where(F.col("kinds") <= GROUP).select(*NAME, "start", "anchor", "core", "piece"))
        pieces = left.where(F.col("kinds") > GROUP).select(*NAME, "start", "anchor", "place", "piece")
    return whole, groups


def repeat_spans(docs: DataFrame, n: int) -> DataFrame:
    """(tag, doc_id, start, stop) in bytes: every ``n``-byte string of ``docs`` that starts at two places at least."""
    shared = shared_runs(docs, "byte", n, GRAM)
    found = shared.where("copies > 1").select(*NAME, start_of().alias("start"), (start_of() + count_of() - 1 + n).alias("stop"))
    # one copy of each content: the others repeat as a whole already
    lists = shared.where("kinds > 1 and lead").groupBy(*NAME).agg(F.collect_list(F.struct("at", "anchor", "kinds")).alias("open"))
    pieces = settled(_pieces(by_name(docs, lists, "inner").select(*NAME, "text", "open"), n), "pieces")
    whole, groups = _divided(pieces.where(F.col("kinds") > GROUP).drop("kinds"), n)
    sortable = pieces.where(F.col("kinds") <= GROUP).select(*NAME, "start", "anchor", F.lit(0).cast("long").alias("core"), "piece")
    for g in groups:
        sortable = sortable.unionByName(g)
    found = found.unionByName(_sorted_repeats(sortable, n))
    return found if whole is None else found.unionByName(whole)


def shared_starts(docs: DataFrame, length: int) -> DataFrame:
    """(tag, doc_id, n_shared): sentence starts of a document whose next ``length`` bytes stand at a sentence start of another one too.

    A sentence starts with the text, after a line feed, or after a full stop and a blank.
    Strings are told apart by two 64-bit hashes, of the whole and of its first half.  Rows
    equal in id and text are one document, whose starts are counted together.
    """

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slabs(offsets, 1 << 22):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                start = np.zeros(len(part) + 1, bool)
                start[2:] = (part[1:] == 32) & (part[:-1] == 46)
                if len(part):
                    start[offs[:-1][offs[:-1] + 1 < len(part)] + 1] = False  # a stop and a blank of this text
                    start[1:] |= part == 10
                start[offs[:-1]] = True
                at = np.flatnonzero(start)
                row = np.searchsorted(offs, at, side="right") - 1
                inside = row < hi - lo
                at, row = at[inside], row[inside]
                inside = at + length <= offs[row + 1]
                at, row = at[inside], row[inside]
                sums, take = prefix_sums(byte_symbols(part)), pa.array(row + lo)
                whole, half = (mix(piece_hash(sums, at, at + k)).view(np.int64) for k in (length, length // 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(whole), pa.array(half)], names=["tag", "doc_id", "whole", "half"])

    starts = docs.mapInArrow(scan, "tag int, doc_id long, whole long, half long")
    doc = F.xxhash64(*NAME)
    known = starts.groupBy("whole", "half").agg(F.count(F.lit(1)).alias("c"), F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo <> hi")
    known = settled(known.select("whole", "half", "c"), "starts")
    return spread_join(starts, known, ["whole", "half"], "c", doc).groupBy(*NAME).agg(F.count(F.lit(1)).alias("n_shared"))


def suffix_dedup(df: DataFrame, n: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int = 160) -> DataFrame:
    """Remove every byte covered by an ``n``-byte string that starts at another place of the corpus too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other
    bytes, binary: a cut may fall inside a character), and n_shared: the sentence starts
    whose next ``passage`` bytes stand in another document too, which also tells of repeated
    passages that are too short to be removed.  Strings are judged on the input.
    """
    docs = identified_docs(df, id_col, text_col)
    found = spans_by_doc(repeat_spans(docs, n), "spans").join(shared_starts(docs, passage), NAME, "full")

    def apply(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = ([], [], [], [])
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                s, kept, gone, marks = span_arrays(batch.column(3), row), text, 0, 0
                if len(s[0]):
                    mask = covered(s, len(text))
                    kept, gone, marks = text[~mask], int(mask.sum()), span_count(mask)
                for o, v in zip(out, (len(text), gone, marks, kept.tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary()), batch.column(4)], names=["tag", "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"]
            )

    joined = by_name(docs, found, "left").select(*NAME, "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    out = joined.mapInArrow(apply, "tag int, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long")
    return out.select(real_id(), "n_bytes", "n_removed", "n_spans", "kept", "n_shared")
