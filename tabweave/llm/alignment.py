"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often which ids do.

Each text is encoded by a byte-level vocabulary A (of space + text) and a piece vocabulary
B (which adds that space).  The byte offsets at which tokens end are two increasing lists
a text.  Their intersection is found by galloping: the shorter list drives, and each of
its ends is sought in the longer one from where the last was found, by steps that double
and then by halving.  The lists of a slab of texts lie end to end, so that many lanes (runs
of 64 ends) gallop side by side.  What it yields:

* ranks: where in the longer list each end of the shorter one falls; differences of
  neighbouring ranks are the ranges of tokens that a token overlaps (``overlaps``);
* common indices, which slice both token lists into groups that cover the same bytes.

Tokens that end a group together are linked.  How many links of the whole corpus hold an
id pair is a second step: a slab of texts (a few MB) names its distinct pairs once, Spark
sums them, and each slab gets back the sums of its own pairs.  So a pair that stands in
every text travels once a slab and no key gathers texts.

Nulls and empty texts have no tokens, and neither has a text whose joined tokens of A or B
differ from space + text: its numbers are zero and its digest is ''.  Null and repeated ids
and repeated rows stay rows of their own.  A very long text is a slab of its own and is
never cut.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import empty_safe, keyed_docs, settled, text_bytes, worker_store
from .core import slabs as cut_slabs

#: Bytes of text that share a table of pairs.
SLAB = 4 << 20
#: Ends of the shorter list that one lane seeks one after another.
LANE = 64
#: What stands outside Latin letters and general punctuation goes to the vocabulary's own library: others may read its classes differently.
_OTHER = re.compile("[^\x00-ɏ -⁯]")
#: The pieces that the byte-level vocabulary splits a text into (fixed by the vocabulary).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, the other way round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """Vocabulary A: ids of space + text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        special = {t["content"] for t in given.get("added_tokens", [])}
        letter = _byte_letters()
        self.bytes = [b"\0"] * (1 + max(given["model"]["vocab"].values()))
        for token, k in given["model"]["vocab"].items():
            self.bytes[k] = token.encode() if token in special else bytes([letter[c] for c in token])
        ranks = {self.bytes[k]: k for token, k in given["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True  # their strings in a text are plain text
        return self._library

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            ids = self.library().encode(" " + t, add_special_tokens=False).ids if _OTHER.search(t) else self._fast.encode_ordinary(" " + t)
            out.append(np.array(ids, dtype=np.int64))
        return out


class PieceTokens:
    """Vocabulary B: ids of the text (the vocabulary adds the space itself), and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self._pieces
        self.bytes = [bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in range(p.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self._pieces.encode(texts, num_threads=1)] if texts else []


class _Tables:
    """Both vocabularies with their bytes, and each id as digits before each sign that may follow it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        assert all(self.a.bytes) and all(self.b.bytes), "each token has a byte at least, else ends would not increase"
        self.a_bytes, self.b_bytes = pa.array(self.a.bytes, pa.large_binary()), pa.array(self.b.bytes, pa.large_binary())
        self.a_len, self.b_len = (np.array([len(x) for x in v.bytes], dtype=np.int64) for v in (self.a, self.b))
        na, nb = len(self.a.bytes), len(self.b.bytes)
        self.at = {"a,": 0, "a|": na, "b,": 2 * na, "b;": 2 * na + nb}
        self.digits = pa.array([f"{k}{s}".encode() for n, s in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for k in range(n)], pa.large_binary())


def _tables(a_path: str, b_path: str) -> _Tables:
    kept = worker_store()
    if ("alignment", a_path, b_path) not in kept:
        kept["alignment", a_path, b_path] = _Tables(a_path, b_path)
    return kept["alignment", a_path, b_path]


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each of the increasing ``needles`` its rank: how many of the increasing ``hay`` are smaller.

    A lane's first needle is placed by halving; each next one starts where the last was
    found, doubles its step while the hay is smaller, and halves the last step.
    """
    n, m = len(needles), len(hay)
    ranks = np.zeros(n, dtype=np.int64)
    if not n or not m:
        return ranks
    heads = np.arange(0, n, LANE)
    low = np.searchsorted(hay, needles[heads])
    ranks[heads] = low
    for k in range(1, min(LANE, n)):
        mine = heads + k
        mine = mine[mine < n]
        low = low[: len(mine)]
        want = needles[mine]
        high, step = low.copy(), np.ones(len(mine), dtype=np.int64)
        low = low.copy()
        going = np.flatnonzero((high < m) & (hay[np.minimum(high, m - 1)] < want))
        while len(going):
            low[going] = high[going] + 1  # all up to here is smaller
            high[going] = np.minimum(high[going] + step[going], m)
            step[going] *= 2
            going = going[high[going] < m]
            going = going[hay[high[going]] < want[going]]
        going = np.flatnonzero(low < high)
        while len(going):
            half = (low[going] + high[going]) // 2
            less = hay[half] < want[going]
            low[going[less]] = half[less] + 1
            high[going[~less]] = half[~less]
            going = going[low[going] < high[going]]
        ranks[mine] = low
    return ranks


def common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices into both lists of the ends that they share, and the ranks of the shorter list's ends in the longer one."""
    turned = len(b_ends) < len(a_ends)
    short, long = (b_ends, a_ends) if turned else (a_ends, b_ends)
    ranks = gallop(short, long)
    met = np.flatnonzero(ranks < len(long))
    met = met[long[ranks[met]] == short[met]]
    return (ranks[met], met, ranks) if turned else (met, ranks[met], ranks)


def overlaps(ends: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, by its end, the first and the last of the other vocabulary's tokens that share a byte with it."""
    last = gallop(ends, others)
    reached = np.concatenate([[0], last[:-1] + (others[np.minimum(last[:-1], len(others) - 1)] == ends[:-1])]) if len(ends) else last
    return reached, last


class Slab:
    """The tokens of some texts, end to end: ids, offsets a text, and the common ends."""

    def __init__(self, tables: _Tables, texts: list[str | None]):
        self.tables, self.n = tables, len(texts)
        rows = [k for k, t in enumerate(texts) if t]
        told = [texts[k] for k in rows]
        a, b = tables.a.encode(told), tables.b.encode(told)
        whole = [(" " + t).encode() for t in told]
        good = [k for k in range(len(rows)) if self._joined(tables.a_bytes, a[k]) == whole[k] == self._joined(tables.b_bytes, b[k])]
        sizes = np.zeros((2, self.n), dtype=np.int64)
        for k in good:
            sizes[0, rows[k]], sizes[1, rows[k]] = len(a[k]), len(b[k])
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate([a[k] for k in good] or none), np.concatenate([b[k] for k in good] or none)
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(s)]) for s in sizes)
        self.a_ends, self.b_ends = np.cumsum(tables.a_len[self.a]), np.cumsum(tables.b_len[self.b])
        self.ia, self.ib, self.ranks = common(self.a_ends, self.b_ends)
        self.g_at = np.searchsorted(self.ia, self.a_at)  # a text's last tokens end together, so no group crosses texts

    @staticmethod
    def _joined(table: pa.Array, ids: np.ndarray) -> bytes:
        return text_bytes(table.take(pa.array(ids)))[0].tobytes()

    def digests(self) -> list[str]:
        """SHA-256 of the groups as text, '' for a text without tokens."""
        at, ia, ib = self.tables.at, self.ia, self.ib
        ga, gb = np.searchsorted(ia, np.arange(len(self.a))), np.searchsorted(ib, np.arange(len(self.b)))
        signs = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        before = np.concatenate([[0], ib + 1])
        signs[np.arange(len(self.a)) + before[ga]] = self.a + np.where(np.isin(np.arange(len(self.a)), ia, assume_unique=True), at["a|"], at["a,"])
        signs[np.arange(len(self.b)) + ia[gb] + 1] = self.b + np.where(np.isin(np.arange(len(self.b)), ib, assume_unique=True), at["b;"], at["b,"])
        data, offsets = text_bytes(self.tables.digits.take(pa.array(signs)))
        ends = offsets[self.a_at + self.b_at]
        return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each link's id pair as one number, and its text."""
        return (self.a[self.ia] << 32) | self.b[self.ib], np.repeat(np.arange(self.n), np.diff(self.g_at))


def _slabs_of(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.Array, Slab]]:
    for batch in batches:
        _, offsets = text_bytes(batch["text"])
        for lo, hi in cut_slabs(offsets, SLAB):
            yield batch["doc_id"].slice(lo, hi - lo), Slab(_tables(a_path, b_path), batch["text"].slice(lo, hi - lo).to_pylist())


_GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, byte_cuts array<long>"


def aligned_groups(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of each text and where they are cut: ``a_cuts`` and ``b_cuts`` count the tokens up to each common end, ``byte_cuts`` its bytes."""
    shape = empty_safe(df.sparkSession.createDataFrame([], _GROUPS).schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _slabs_of(batches, a_path, b_path):
            first = np.repeat(np.arange(s.n), np.diff(s.g_at))
            from_byte = np.concatenate([[0], s.a_ends])[s.a_at[:-1]]
            lists = [
                (s.a, s.a_at, pa.int32()), (s.b, s.b_at, pa.int32()), (s.ia + 1 - s.a_at[first], s.g_at, pa.int32()),
                (s.ib + 1 - s.b_at[first], s.g_at, pa.int32()), (s.a_ends[s.ia] - from_byte[first], s.g_at, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, at, t in lists]], schema=shape)

    return keyed_docs(df, id_col, text_col).mapInArrow(told, _GROUPS)


#: A text's row: where its pairs stand in the slab's table, and how often each; the slab's own row: its table, with no numbers of a text.
_COUNTED = "slab long, pairs array<long>, sums array<long>, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, at array<int>, times array<int>"
_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(a_path: str, b_path: str, shape: pa.Schema):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, (ids, s) in enumerate(_slabs_of(batches, a_path, b_path)):
            codes, text = s.links()
            pairs, where, sums = np.unique(codes, return_inverse=True, return_counts=True)
            seen, times = np.unique(text * max(1, len(pairs)) + where, return_counts=True)
            own = np.searchsorted(seen, np.arange(s.n + 1) * max(1, len(pairs)))
            n, slab = s.n, base + k
            listed = lambda v, t: pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(v, t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, slab)), pa.nulls(n, shape.field("pairs").type), pa.nulls(n, shape.field("sums").type), ids,
                    pa.array(np.diff(s.a_at)), pa.array(np.diff(s.b_at)), pa.array(np.diff(s.g_at)), pa.array(s.digests(), pa.string()),
                    listed(seen % max(1, len(pairs)), pa.int32()), listed(times, pa.int32()),
                ], schema=shape,
            )
            rest = [pa.nulls(1, f.type) for f in list(shape)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([pairs.tolist()], shape.field("pairs").type), pa.array([sums.tolist()], shape.field("sums").type), *rest], schema=shape)

    return told


def _scored(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """A slab's texts with the corpus-wide counts of its pairs added up."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = pairs["pos"].to_numpy()
    count[at], best[at] = pairs["n"].to_numpy(), pairs["is_best"].to_numpy()
    texts = texts.combine_chunks()
    lists, many = texts["at"].combine_chunks(), texts["times"].combine_chunks()
    sizes = lists.value_lengths().to_numpy() if texts.num_rows else np.zeros(0, np.int64)
    where, times = lists.flatten().to_numpy(), many.flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
    return texts.select(["doc_id", "n_a", "n_b", "n_groups"]).append_column("n_links", pa.array(summed(times))).append_column("n_best", pa.array(summed(times * best[where]))).append_column("count_sum", pa.array(summed(times * count[where]))).append_column("groups_sha256", texts["groups_sha256"])


def cross_tokenizer_alignment(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is, corpus-wide, as frequent as any with its id of
    B; ``count_sum`` adds up the links' corpus-wide counts.
    """
    spark = df.sparkSession
    shape = empty_safe(spark.createDataFrame([], _COUNTED).schema)
    told = settled(keyed_docs(df, id_col, text_col).mapInArrow(_counted(a_path, b_path, shape), _COUNTED), "aligned")
    texts = told.where("pairs is null").drop("pairs", "sums")
    own = told.where("pairs is not null").select("slab", F.posexplode(F.arrays_zip("pairs", "sums"))).select("slab", "pos", F.col("col.pairs").alias("pair"), F.col("col.sums").alias("sums"))
    total = settled(own.groupBy("pair").agg(F.sum("sums").alias("n")), "pairs")
    # a B id stands with no more ids than A has, and only its highest count meets its pairs
    piece = F.col("pair").bitwiseAND((1 << 32) - 1).alias("piece")
    top = total.groupBy(piece).agg(F.max("n").alias("top"))
    known = total.withColumn("piece", piece).join(top, "piece").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    back = own.join(known, "pair").select(F.col("slab").alias("of_slab"), "pos", "n", F.col("is_best").cast("long").alias("is_best"))
    return texts.groupBy("slab").cogroup(back.groupBy("of_slab")).applyInArrow(_scored, _DONE)
