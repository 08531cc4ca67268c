"""Substring dedup by Rabin-Karp hashes of every fixed-length token window.

Windows are hashed in the scan, travel as runs (see ``repeats``), and are counted in
Spark; what repeats an earlier window is removed as maximal intervals.

Nulls: a null text has no words; rows with a null id sort after all others, by a hash of
their text.  No row is earlier than another of the same id (nor are copies without an id).
Empty texts and texts shorter than a window are kept whole.  An empty table gives no rows.
Only the named id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NAME, identified_docs, mix, real_id, settled, spread_join, text_bytes
from .repeats import by_name, count_of, covered, first_doc, is_first, piece_hash, prefix_sums, shared_runs, span_arrays, span_count, spans_by_doc, start_of, word_bounds, word_symbols

GRAM = 5


def _windows(docs_runs: DataFrame, n: int) -> DataFrame:
    """From (tag, doc_id, text, wanted runs) to one row a window of those runs: NAME, start, anchor, its Rabin-Karp hash, head.

    ``head`` says that no window of the same words starts earlier in the document.
    """

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, starts, anchors, hashes, heads = [], [], [], [], []
            for row in range(batch.num_rows):
                v = batch.column(3)[row].values
                at, anchor = v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False)
                text = data[offsets[row] : offsets[row + 1]]
                a, b, _ = word_bounds(text, np.array([0, len(text)]))
                inside = (at >> 16) + ((at & 0xFFFF) >> 1) - 1 + n <= len(a)
                at, anchor = at[inside], anchor[inside]
                sums = prefix_sums(word_symbols(text, a, b))
                count = (at & 0xFFFF) >> 1
                place = np.repeat((at >> 16) - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                hashed = mix(piece_hash(sums, place, place + n)).view(np.int64)
                order = np.lexsort((place, hashed))
                head = np.empty(len(place), bool)
                head[order] = np.append(True, np.diff(hashed[order]) != 0)[: len(order)]
                ids.append(np.full(len(place), row))
                starts.append(place)
                anchors.append(np.repeat(anchor, count))
                hashes.append(hashed)
                heads.append(head)
            if ids:
                take = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(heads))],
                    names=["tag", "doc_id", "start", "anchor", "hash", "head"],
                )

    return docs_runs.mapInArrow(scan, "tag int, doc_id long, start long, anchor long, hash long, head boolean")


def removal_spans(docs: DataFrame, n: int) -> DataFrame:
    """(tag, doc_id, start, stop) in words: every window whose words start earlier in the corpus too.

    The texts are shuffled by name once: this join and the caller's share that exchange.
    """
    shared = shared_runs(docs, "word", n, GRAM)
    copies = shared.where("copies > 1 and not lead").select(*NAME, start_of().alias("start"), (start_of() + count_of() - 1 + n).alias("stop"))
    open_runs = shared.where("kinds > 1 and lead").groupBy(*NAME).agg(F.collect_list(F.struct("at", "anchor")).alias("open"))
    windows = _windows(by_name(docs, open_runs, "inner").select(*NAME, "text", "open"), n)
    first = settled(windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c"), *first_doc()).where("c > 1"), "windows")
    met = spread_join(windows, first, ["anchor", "hash"], "c", F.xxhash64("doc_id", "start"))
    later = met.where(~(is_first() & F.col("head")))
    return copies.unionByName(later.select(*NAME, "start", (F.col("start") + n).alias("stop")))


def substring_dedup(df: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by an ``n``-word window that also starts earlier (smaller id, or earlier in the same text).

    Returns doc_id, n_words, n_removed, n_spans (maximal removed intervals), kept_text
    (the other words joined by one space).  Windows are judged on the input.
    """
    docs = identified_docs(df, id_col, text_col)
    spans = spans_by_doc(removal_spans(docs, n), "spans")

    def apply(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            out = ([], [], [], [])
            for row in range(batch.num_rows):
                words = raw[offsets[row] : offsets[row + 1]].split()
                gone = 0
                marks = 0
                s = span_arrays(batch.column(3), row)
                total = len(words)
                if len(s[0]):
                    mask = covered(s, total)
                    gone, marks = int(mask.sum()), span_count(mask)
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                for o, v in zip(out, (total, gone, marks, b" ".join(words))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())], names=["tag", "doc_id", "n_words", "n_removed", "n_spans", "kept_text"]
            )

    joined = by_name(docs, spans, "left").select(*NAME, "text", "spans")
    out = joined.mapInArrow(apply, "tag int, doc_id long, n_words long, n_removed long, n_spans long, kept_text string")
    return out.select(real_id(), "n_words", "n_removed", "n_spans", "kept_text")
