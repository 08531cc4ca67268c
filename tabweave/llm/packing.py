"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Documents are tokenised where they lie; longer ones are cut at the capacity.  Pieces of
equal length are interchangeable, and so are sequences with equal gaps, so the state of a
round is a table of length classes and a table of gap ranges, whose sizes depend on the
capacity and not on the corpus.  A round is one Spark job over both:

* lengths and gaps are sorted together, from large to small; a gap opens as many places as
  it has sequences, a length asks for as many as it has pieces, and running sums of the two
  say how many places are open;
* the sweep: within a stretch of that sum each request takes the place opened last before
  it, which is the smallest gap that is free and suffices (the successor of the length);
* conflicts are resolved by rank: a gap's sequences and a length's pieces are numbered, the
  numbers follow from the sums, and what finds no place waits for the next round;
* gaps shrink by what they took, and the next round follows.  Where a round places nothing,
  new sequences open for what is left.

Spark ranks the pieces within their length (numbered in hashed buckets) and finds each
one's match by an equi-join on (length, block of ranks).

Nulls: a null text is empty, and an empty text still has its end token.  Rows with null
or repeated ids are packed like any other.  An empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import keyed_docs, settled, text_bytes, worker_store
from .kd_sharding import numbered

END_ID = 0
#: Distinct words whose ids a worker keeps; beyond it the cache starts anew.
CACHE = 600_000
#: Letters that the vocabulary takes as they are: small ASCII and Latin-1.
_LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
_PLAIN = re.compile(_LETTERS)
#: Words of such letters, digits and ASCII signs fall apart into runs of letters, single digits and runs of signs.
#: Not so where an apostrophe makes a contraction or a special id might begin.
_SIMPLE = re.compile(rb"(?:" + _LETTERS + rb"|[!-&(-;=-@\[-`{-~])+")
_RUNS = re.compile(_LETTERS + rb"|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
#: Ranks that share a block in the join of pieces with matches.
BLOCK = 1024
#: Rounds after which packing fails loudly: each places a piece or opens sequences.
ROUNDS = 10_000


class _Words(dict):
    """Ids (little-endian, 32 bits) of words, learned where they are missing."""

    def __init__(self, path: str):
        # tasks fill the cores: threads of the tokenizer's own would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the vocabulary writes a byte as a printable character: those that are not printable follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        if _PLAIN.fullmatch(word):
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))])
        elif _SIMPLE.fullmatch(word) and len(runs := _RUNS.findall(word)) > 1:
            got = b"".join([self[r] for r in runs])
        else:
            got = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got


def _encoder(path: str):
    """From UTF-8 texts to little-endian 32-bit ids, a word at a time.

    White space never joins words in this vocabulary and case does not count, so a worker
    works out a word once.
    """
    kept = worker_store()
    if ("tokenizer", path) not in kept:
        kept["tokenizer", path] = _Words(path)
    words = kept["tokenizer", path]

    def encode(texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            if len(words) > CACHE:
                words.clear()
            out.append(b"".join(map(words.__getitem__, t.split())))
        return out

    return encode


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of Latin-1 made small."""
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    if not len(second):
        return data
    data = data.copy()
    data[second] += 0x20
    return data


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and if asked for ids (little-endian 32-bit)."""
    end = np.array([END_ID], "<u4").tobytes()

    def scan(batches):
        encode = _encoder(tokenizer_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            data = lowered(data)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                offs = (offsets[lo : lo + 257] - offsets[lo]).tolist()
                # ASCII capitals are lowered here too; the vocabulary's own lower-casing sees to all others
                given = data[offsets[lo] : offsets[lo] + offs[-1]].tobytes()
                raw = given.lower()
                # names of special ids count in their own spelling only
                special = b"<|" in raw
                texts = [given[a:z] if special and b"<|" in raw[a:z] else raw[a:z] for a, z in zip(offs, offs[1:])]
                rows, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
                for row, got in enumerate(encode(texts)):
                    got += end
                    for k, a in enumerate(range(0, len(got), 4 * capacity)):
                        own = got[a : a + 4 * capacity]
                        rows.append(row)
                        numbers.append(k)
                        starts.append(a // 4)
                        lengths.append(len(own) // 4)
                        sums.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)), *([pa.array(ids, pa.binary())] if keep_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])],
                )

    return keyed_docs(df, id_col, text_col).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def _sweep(gaps: DataFrame, lengths: DataFrame, bundle: int, capacity: int) -> DataFrame:
    """The matches of one round: length, first (rank), pieces, each (of a sequence), sequence, offset, and the gap range used.

    ``gaps`` is (gap, first, n): sequences first .. first + n - 1 have that much room;
    ``lengths`` is (length, done, left).  ``bundle`` pieces of a length may go together.
    """
    each = F.least(F.lit(bundle), F.floor(F.lit(capacity) / F.col("length")), F.col("left")).cast("long")
    opens = gaps.select(F.col("gap").alias("size"), F.lit(0).alias("asks"), F.col("first").alias("id"), F.col("n").alias("count"), F.lit(0).cast("long").alias("each"), F.col("gap").alias("what"))
    asks = lengths.where("left > 0").withColumn("each", each)
    asks = asks.select((F.col("length") * F.col("each")).alias("size"), F.lit(1).alias("asks"), F.col("done").alias("id"), F.floor(F.col("left") / F.col("each")).alias("count"), "each", F.col("length").alias("what"))
    order = Window.orderBy(F.desc("size"), "asks", "what", "id")  # classes: their number does not grow with the corpus
    step = F.when(F.col("asks") == 0, F.col("count")).otherwise(-F.col("count"))
    seen = opens.unionByName(asks).withColumn("after", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.row_number().over(order))
    seen = seen.withColumn("lo", F.least("after", F.col("after") - step)).withColumn("hi", F.greatest("after", F.col("after") - step))
    # the stretches between all values that the sum takes, and which of them an event crosses
    marks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi")).over(Window.partitionBy()))))
    seen = seen.withColumn("marks", marks)
    seen = seen.withColumn("k", F.explode(F.sequence(F.array_position("marks", F.col("lo")), F.array_position("marks", F.col("hi")) - 1)))
    seen = seen.withColumn("bottom", F.element_at("marks", F.col("k").cast("int"))).withColumn("top", F.element_at("marks", F.col("k").cast("int") + 1)).drop("marks")
    last = F.lag(F.struct("asks", "t", "what", "id", "lo")).over(Window.partitionBy("k").orderBy("t"))
    met = seen.withColumn("open", last).where("asks = 1 and open.asks = 0")
    met = met.groupBy("t", "open").agg(F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.first("what").alias("length"), F.first("id").alias("done"), F.first("hi").alias("hi"), F.first("each").alias("each"))
    return met.select(
        "length", (F.col("done") + (F.col("hi") - F.col("top")) * F.col("each")).alias("first"), ((F.col("top") - F.col("bottom")) * F.col("each")).alias("pieces"), "each",
        (F.col("open.id") + F.col("bottom") - F.col("open.lo")).alias("sequence"), (F.lit(capacity) - F.col("open.what")).alias("offset"), F.col("open.what").alias("gap"), F.col("open.id").alias("range"),
    )


def match_rounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """Matches (length, first, pieces, each, sequence, offset) for (length, n): rank r of a length belongs to the match that covers it.

    The j-th group of ``each`` ranks from ``first`` on goes to sequence + j, one piece behind the other from ``offset`` on.
    """
    spark = lengths.sparkSession
    cells = ["length", "first", "pieces", "each", "sequence", "offset"]
    schema = ", ".join(f"{c} long" for c in cells)
    full, more, tokens = lengths.agg(F.sum(F.when(F.col("length") == capacity, F.col("n"))), F.sum(F.when((F.col("length") < capacity) & (2 * F.col("length") > capacity), F.col("n"))), F.sum(F.when(F.col("length") < capacity, F.col("n") * F.col("length")))).first()
    full, more, tokens = full or 0, more or 0, tokens or 0
    # whole pieces fill a sequence each; of those over half no two share one
    found = [spark.createDataFrame([(capacity, 0, full, 1, 0, 0)] if full else [], schema)]
    opened = max(more, -(-tokens // capacity))
    gaps = spark.createDataFrame([(capacity, full, opened)] if opened else [], "gap long, first long, n long")
    state = lengths.where(F.col("length") < capacity).select(F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("done"), F.col("n").cast("long").alias("left"))
    left, room, opened = 1 if tokens else 0, opened, opened + full
    for _ in range(ROUNDS):
        if not left:
            break
        # one table a round: its matches, the gaps after them and what is left of the lengths
        now = settled(_after(_sweep(gaps, state, max(1, left // (8 * max(1, room))), capacity), gaps, state), "round")
        was = left
        sums = now.agg(F.sum(F.when(F.col("kind") == LENGTH, F.col("v2"))), F.sum(F.when(F.col("kind") == LENGTH, F.col("v2") * F.col("x"))), F.sum(F.when(F.col("kind") == GAP, F.col("v1"))))
        left, tokens, room = (v or 0 for v in sums.first())
        gaps = now.where(F.col("kind") == GAP).select(F.col("x").alias("gap"), F.col("y").alias("first"), F.col("v1").alias("n"))
        state = now.where(F.col("kind") == LENGTH).select(F.col("x").alias("length"), F.col("v1").alias("done"), F.col("v2").alias("left"))
        found.append(now.where(F.col("kind") == MATCH).select(*[F.col(c).alias(n) for c, n in zip(("x", "y", "v1", "v2", "v3", "v4"), cells)]))
        if left and left == was:
            new = -(-tokens // capacity)
            gaps = gaps.unionByName(spark.createDataFrame([(capacity, opened, new)], "gap long, first long, n long"))
            opened, room = opened + new, room + new
    else:
        raise RuntimeError(f"packing did not settle in {ROUNDS} rounds")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Kinds of rows of a round's table.
MATCH, GAP, LENGTH = 0, 1, 2


def _after(matches: DataFrame, gaps: DataFrame, lengths: DataFrame) -> DataFrame:
    """A round's table (kind, x, y, v1, v2, v3, v4), added up by kind, x and y.

    MATCH: length, first rank; pieces, each, sequence, offset.  GAP: gap, first sequence;
    sequences.  LENGTH: length, 0; pieces placed, pieces left.  A match adds a gap for the
    sequences that it fills up, and takes them from the gap and its pieces from the length.
    """
    row = lambda kind, x, y, *v: F.struct(*[(c if not isinstance(c, int) else F.lit(c)).cast("long").alias(n) for c, n in zip((kind, x, y, *v), ("kind", "x", "y", "v1", "v2", "v3", "v4"))])
    groups = F.col("pieces") / F.col("each")
    told = matches.select(F.inline(F.array(
        row(MATCH, F.col("length"), F.col("first"), F.col("pieces"), F.col("each"), F.col("sequence"), F.col("offset")),
        row(GAP, F.col("gap") - F.col("length") * F.col("each"), F.col("sequence"), groups, 0, 0, 0),
        row(GAP, F.col("gap"), F.col("range"), -groups, 0, 0, 0),
        row(LENGTH, F.col("length"), 0, F.col("pieces"), -F.col("pieces"), 0, 0),
    )))
    old = gaps.select(row(GAP, F.col("gap"), F.col("first"), F.col("n"), 0, 0, 0).alias("r")).unionByName(lengths.select(row(LENGTH, F.col("length"), 0, F.col("done"), F.col("left"), 0, 0).alias("r"))).select("r.*")
    summed = told.unionByName(old).groupBy("kind", "x", "y").agg(*[F.sum(v).alias(v) for v in ("v1", "v2", "v3", "v4")])
    return summed.where((F.col("kind") != GAP) | ((F.col("x") > 0) & (F.col("v1") > 0)))


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows that have a length: ``found`` is settled, one row a piece."""
    counts = settled(found.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    matches = match_rounds(counts, capacity)
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = numbered(found, "length", ["doc_id", "piece", "ids_crc32"], rows, "rank")
    # a match covers a range of ranks: it goes to each block of ranks that it reaches
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("pieces") - 1) / BLOCK))).alias("_k")
    reach = matches.select("length", blocks, F.col("first").alias("_f"), F.col("pieces").alias("_n"), F.col("each").alias("_e"), F.col("sequence").alias("_s"), F.col("offset").alias("_o"))
    inside = F.col("rank") - F.col("_f")
    hit = ranked.withColumn("_k", F.floor(F.col("rank") / BLOCK)).join(reach.hint("merge"), ["length", "_k"]).where((inside >= 0) & (inside < F.col("_n")))
    return hit.withColumn("sequence_id", F.col("_s") + F.floor(inside / F.col("_e"))).withColumn("offset", F.col("_o") + inside % F.col("_e") * F.col("length")).drop("rank", "_k", "_f", "_n", "_e", "_s", "_o")


def best_fit_packing(df: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset.

    Offsets within a sequence are gapless from 0.  The ids are written once with their
    piece and not shuffled unless ``keep_ids`` asks for them in the result.
    """
    found = settled(pieces(df, tokenizer_path, capacity, id_col, text_col, keep_ids), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset")
