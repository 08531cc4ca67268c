"""Prefix trie of conversations, packed as double arrays by shards of prefixes.

A turn is named by 128 hash bits of role and text, so texts are read once and stay where
they are.  Conversations become sequences of turns, equal sequences are counted before
anything else, and the distinct sequences are sorted over the cluster: a shard is a stretch
of that order, so it holds whole subtrees but for the nodes on the paths of its first and
its last sequence.  Within a task, stretches of at most ``STRETCH`` turns are shards of
their own, so memory does not depend on how many sequences a task got.

A shard numbers its distinct turns densely and packs its trie into two arrays: the child of
node s by turn c lies at BASE[s] + c, and CHECK there names s.  Sequences are then walked
through the arrays, all at once a level, and nodes add up what passes and ends at them.

Nodes inside a shard are complete.  Those on its two outer paths may go on in the next
shard: they leave as parts and are merged over all shards by name.  In the order of (first
path on which a node lies, depth) a subtree is a stretch, so sums over subtrees of merged
nodes are differences of running sums, whatever the depth.

The digest of the conversations that end at a node reads their ids in order: ranges of ids
are joined to pieces first, so that a node with a third of all conversations reads few rows.

Nulls: a null role or text is empty, a null turn comes first, rows without conv_id belong
to no conversation.  Rows of equal conversation and turn come in the order of their hash,
and repeated rows are turns of their own.  Negative ids take c % 20 as SQL gives it, towards
zero.  An empty table has no conversation, so no root, and gives no rows.  Only the named
columns are read.  The turn names (20 bytes a turn) of one conversation lie in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import WORD, empty_safe, mix, parallelism, settled, spread_join

#: Turns that one double array is packed from.
STRETCH = 1 << 18
#: Turns that a task sorts, about.
SHARD_TURNS = 1 << 20
#: Ids that are joined to one piece of a digest.
PIECE = 1024
#: What the textless root is named.
ROOT = 1


def conversation_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation as an ordered list of (hi, lo, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    name = rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("hi"), F.xxhash64(F.lit(1), "text", "role").alias("lo"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), "hi", "lo", "words")))
    return name.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``family``; h = crc32(c) % ``shared``."""
    c = F.col("conv_id")
    heads = convs.where(c % family == 0).select(c.alias("head"), F.slice("turns", 1, shared - 1).alias("first"))
    own = convs.withColumn("head", c - c % family).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % shared).cast("int"))
    first = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    # a conversation that is its own head stays as it is
    both = F.when(c == F.col("head"), F.col("turns")).otherwise(F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))))
    return own.join(heads, "head", "left").select("conv_id", both.alias("turns"))


def _sequence_name() -> list[Column]:
    return [F.xxhash64("turns").alias("s_hi"), F.xxhash64(F.lit(1), "turns").alias("s_lo")]


def end_digests(convs: DataFrame) -> DataFrame:
    """For each sequence (by its name) the SHA-256 of its conversations' ids in order, joined by commas."""
    ids = convs.select("s_hi", "s_lo", F.floor(F.col("conv_id") / PIECE).alias("range"), "conv_id")
    pieces = ids.groupBy("s_hi", "s_lo", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("s_hi", "s_lo").sortWithinPartitions("s_hi", "s_lo", "range")
    schema = "s_hi long, s_lo long, sha string"
    shape = empty_safe(convs.sparkSession.createDataFrame([], schema).schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for hi, lo, text in zip(*(batch[c].to_pylist() for c in ("s_hi", "s_lo", "ids"))):
                if (hi, lo) == now:
                    sha.update(b",")
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (hi, lo), hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done) if done else ([], [], []), shape)], schema=shape)
            done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*now, sha.hexdigest()), shape)], schema=shape)

    return ordered.select("s_hi", "s_lo", "ids").mapInArrow(told, schema)


class DoubleArray:
    """A trie of sorted, distinct sequences of dense turn numbers (1, 2, ...) in BASE and CHECK."""

    def __init__(self, labels: np.ndarray, at: np.ndarray):
        """``labels``: the sequences' turns end to end; ``at``: where each begins, and the end."""
        self.labels, self.at, self.sizes = labels, at, np.diff(at)
        self.base, self.check = np.zeros(2, np.int64), np.full(2, -1, np.int64)
        self.check[ROOT] = 0
        self.free = 2  # all slots below are taken or given up
        here, rows = np.full(len(self.sizes), ROOT), np.arange(len(self.sizes))
        for level in range(int(self.sizes.max(initial=0))):
            rows = rows[self.sizes[rows] > level]
            turns = labels[at[rows] + level]
            first = np.ones(len(rows), bool)
            first[1:] = (here[rows][1:] != here[rows][:-1]) | (turns[1:] != turns[:-1])
            self._place(here[rows][first], turns[first])
            here[rows] = self.base[here[rows]] + turns

    def _grow(self, slots: int) -> None:
        if slots > len(self.check):
            more = max(slots, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _gaps(self, many: int) -> np.ndarray:
        """The next ``many`` free slots."""
        reach = 2 * many + 64
        while True:
            self._grow(self.free + reach)
            gaps = self.free + np.flatnonzero(self.check[self.free : self.free + reach] < 0)
            if len(gaps) >= many:
                return gaps[:many]
            reach *= 2

    def _place(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Find a BASE for each parent (children lie together, in order) such that all its children fall on free slots."""
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        many = np.diff(np.append(starts, len(parents)))
        for k in np.flatnonzero(many > 1):
            mine = turns[starts[k] : starts[k] + many[k]]
            spread, tried = mine - mine[0], 1
            while True:
                gap = self._gaps(tried)[-1]
                self._grow(int(gap + spread[-1]) + 1)
                if (self.check[gap + spread] < 0).all():
                    break
                tried += 1
                if tried > 16:  # a crowded start: give up the slots below
                    self.free, tried = int(gap), 1
            self.base[parents[starts[k]]] = gap - mine[0]
            self.check[gap + spread] = parents[starts[k]]
        single = starts[many == 1]
        if len(single):
            gaps = self._gaps(len(single))
            self.base[parents[single]] = gaps - turns[single]
            self.check[gaps] = parents[single]
            self.free = int(gaps[-1]) + 1

    def walked(self) -> np.ndarray:
        """The slot that each turn of each sequence leads to: BASE by turn, held against CHECK."""
        slots, here, rows = np.zeros(len(self.labels), np.int64), np.full(len(self.sizes), ROOT), np.arange(len(self.sizes))
        for level in range(int(self.sizes.max(initial=0))):
            rows = rows[self.sizes[rows] > level]
            to = self.base[here[rows]] + self.labels[self.at[rows] + level]
            if (self.check[to] != here[rows]).any():
                raise RuntimeError("a sequence left the trie it was packed in")
            slots[self.at[rows] + level] = here[rows] = to
        return slots


#: Nodes as shards tell of them.  ``lo`` and ``hi`` are null for complete nodes, else the outer paths on which a part lies.
_NODES = "lo long, hi long, k_hi long, k_lo long, p_hi long, p_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _chained(hi: np.ndarray, lo: np.ndarray, k_hi: np.ndarray, k_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of a node from its parent's name and its turn."""
    with np.errstate(over="ignore"):
        return mix(k_hi * np.uint64(0x9E3779B97F4A7C15) + hi), mix(k_lo * np.uint64(0xC2B2AE3D27D4EB4F) + lo)


def shard_nodes(hi: np.ndarray, lo: np.ndarray, words: np.ndarray, at: np.ndarray, n: np.ndarray, least: np.ndarray, sha: np.ndarray, path: int) -> dict[str, np.ndarray]:
    """The nodes of one shard: its sequences (sorted, distinct) with how many conversations each has, the smallest of them, and their digest."""
    both = np.stack([hi, lo], 1).astype(np.int64).view([("hi", np.int64), ("lo", np.int64)])[:, 0] if len(hi) else np.zeros(0, [("hi", np.int64), ("lo", np.int64)])
    # dense numbers in the order of names: sequences stay sorted
    labels = np.unique(both, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1 if len(both) else np.zeros(0, np.int64)
    trie = DoubleArray(labels, at)
    slots, sizes = trie.walked(), trie.sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    # nodes in the order of (depth, first sequence); the root is node 0
    level = np.arange(len(labels)) - at[row]
    order = np.argsort(level, kind="stable")
    _, first = np.unique(slots[order], return_index=True)
    first = order[np.sort(first)]
    node_of = np.zeros(len(trie.check), np.int64)
    node_of[slots[first]] = np.arange(1, len(first) + 1)
    count = len(first) + 1
    parent, depth = np.zeros(count, np.int64), np.zeros(count, np.int64)
    parent[1:], depth[1:] = node_of[trie.check[slots[first]]], level[first] + 1
    weight = np.zeros(count, np.int64)
    weight[1:] = words[first]
    passes = np.concatenate([np.zeros(len(sizes), np.int64), node_of[slots]])
    of = np.concatenate([np.arange(len(sizes)), row])
    n_convs, conv = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
    np.add.at(n_convs, passes, n[of])
    np.minimum.at(conv, passes, least[of])
    ends = np.zeros(len(sizes), np.int64)
    ends[sizes > 0] = node_of[slots[at[1:][sizes > 0] - 1]]
    shas = np.full(count, None, object)
    shas[ends] = sha
    k_hi, k_lo = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    bounds = np.searchsorted(depth, np.arange(depth[-1] + 2))
    for d in range(1, depth[-1] + 1):
        here = slice(bounds[d], bounds[d + 1])
        at_turn = first[bounds[d] - 1 : bounds[d + 1] - 1]
        k_hi[here], k_lo[here] = _chained(hi[at_turn].view(np.uint64), lo[at_turn].view(np.uint64), k_hi[parent[here]], k_lo[parent[here]])
    # nodes on the first and the last path are parts
    outer_lo, outer_hi = np.full(count, -1), np.full(count, -1)
    for k, p in ((len(sizes) - 1, path + 1), (0, path)):
        mine = np.append(node_of[slots[at[k] : at[k + 1]]], 0)
        outer_lo[mine], outer_hi[mine] = p, np.maximum(outer_hi[mine], p)
    part = outer_lo >= 0
    # from the deepest level up, complete children into their parents; a part's own share waits for the merge
    children, leaves, saved = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for d in range(depth[-1], -1, -1):
        here = np.arange(bounds[d], bounds[d + 1])
        whole = here[~part[here]]
        leaves[whole] += children[whole] == 0
        saved[whole] += (n_convs[whole] - 1) * weight[whole]
        if d:
            np.add.at(children, parent[whole], 1)
            np.add.at(leaves, parent[whole], leaves[whole])
            np.add.at(saved, parent[whole], saved[whole])
    return {
        "lo": np.ma.array(outer_lo, mask=~part), "hi": np.ma.array(outer_hi, mask=~part), "k_hi": k_hi.view(np.int64), "k_lo": k_lo.view(np.int64),
        "p_hi": k_hi[parent].view(np.int64), "p_lo": k_lo[parent].view(np.int64), "depth": depth, "conv_id": conv,
        "parent_conv_id": np.ma.array(conv[parent], mask=part[parent] | part), "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "words": weight,
        "ends_sha256": np.array([None if p and s is None else s or _EMPTY for s, p in zip(shas, part)], object),
    }


def _shards(shape: pa.Schema):
    """Stretches of a task's sorted sequences, each packed and walked."""

    def packed(rows: list[pa.RecordBatch], path: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        lists = t["turns"].combine_chunks()
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        hi, lo, words = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in lists.flatten().flatten())
        got = shard_nodes(hi, lo, words.astype(np.int64), at, t["n"].to_numpy(), t["least"].to_numpy(), t["sha"].to_numpy(), path)
        arrays = [pa.array(v.data, f.type, mask=np.ma.getmaskarray(v)) if isinstance(v, np.ma.MaskedArray) else pa.array(v, f.type) for v, f in ((got[f.name], f) for f in shape)]
        return pa.RecordBatch.from_arrays(arrays, schema=shape)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = np.cumsum(batch["turns"].value_lengths().to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STRETCH - turns, side="right")))
                held.append(batch.slice(lo, hi - lo))
                turns += int(sizes[min(hi, batch.num_rows) - 1] - (sizes[lo - 1] if lo else 0))
                lo = hi
                if turns >= STRETCH or lo < batch.num_rows:
                    yield packed(held, path)
                    path, held, turns = path + 2, [], 0
        if held:
            yield packed(held, path)

    return told


def merged(parts: DataFrame) -> DataFrame:
    """Outer nodes of all shards, their parts put together, with sums over their subtrees.

    There are at most two paths a shard.  ``inner`` counts complete children, whose parent
    may be any of these nodes.
    """
    one = parts.groupBy("k_hi", "k_lo", "p_hi", "p_lo", "depth").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
    )
    one = settled(one, "outer")
    below = one.where("depth > 0").groupBy(F.col("p_hi").alias("k_hi"), F.col("p_lo").alias("k_lo"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("outer"))
    full = one.join(below, ["k_hi", "k_lo", "depth"], "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    full = full.withColumn("leaf", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("own", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    # running sums along a path, then over the paths (two a shard)
    along = Window.partitionBy("lo").orderBy("depth")
    full = full.withColumns({"leaf_run": F.sum("leaf").over(along), "own_run": F.sum("own").over(along)})
    full = settled(full, "outer")
    paths = full.groupBy("lo").agg(F.sum("leaf").alias("path_leaf"), F.sum("own").alias("path_own"))
    order = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    paths = settled(paths.select("lo", F.sum("path_leaf").over(order).alias("to_leaf"), F.sum("path_own").over(order).alias("to_own"), "path_leaf", "path_own", F.lead("lo").over(Window.orderBy("lo")).alias("next")), "paths")
    own_path = full.join(paths.select("lo", (F.col("to_leaf") - F.col("path_leaf")).alias("from_leaf"), (F.col("to_own") - F.col("path_own")).alias("from_own")), "lo")
    # the last path within a subtree on which some node lies first
    last = one.select(F.col("hi").alias("want")).distinct().withColumn("is", F.lit(1))
    marks = paths.select(F.col("lo").alias("want"), "to_leaf", "to_own").unionByName(last.select("want"), allowMissingColumns=True)
    filled = marks.groupBy("want").agg(F.max("to_leaf").alias("to_leaf"), F.max("to_own").alias("to_own"))
    upto = filled.select("want", *[F.last(c, ignorenulls=True).over(Window.orderBy("want").rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("to_leaf", "to_own")])
    got = own_path.join(upto, own_path["hi"] == upto["want"])
    return got.select(
        "k_hi", "k_lo", "p_hi", "p_lo", "depth", "conv_id", "n_convs", "n_children", "inner", (F.col("to_leaf") - F.col("from_leaf") - F.col("leaf_run") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_own") - F.col("from_own") - F.col("own_run") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``convs`` (conv_id, turns as ``conversation_turns`` gives them, one row a conversation).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; sums and counts are over all conversations.
    """
    spark = convs.sparkSession
    named = settled(convs.select("conv_id", "turns", *_sequence_name()), "sequences")
    ends = settled(end_digests(named), "ends")
    counted = named.groupBy("s_hi", "s_lo", "turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    paths = settled(counted.join(ends, ["s_hi", "s_lo"]).select("turns", "n", "least", "sha"), "distinct")
    rows, turns = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()
    shards = max(1, min(rows, max(parallelism(spark), turns // SHARD_TURNS)))
    shape = empty_safe(spark.createDataFrame([], _NODES).schema)
    nodes = settled(paths.repartitionByRange(shards, "turns").sortWithinPartitions("turns").mapInArrow(_shards(shape), _NODES), "nodes")
    outer = settled(merged(nodes.where("lo is not null")), "merged")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parent = outer.select(F.col("k_hi").alias("p_hi"), F.col("k_lo").alias("p_lo"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("inner").alias("size"))
    inner = nodes.where("lo is null")
    known = inner.where("parent_conv_id is not null").select(*out)
    # below an outer node (the root, say) there may be a large part of all nodes
    met = spread_join(inner.where("parent_conv_id is null").drop("parent_conv_id"), parent, ["p_hi", "p_lo", "depth"], "size", F.xxhash64("k_hi"))
    tops = outer.join(parent.drop("size"), ["p_hi", "p_lo", "depth"], "left")
    return known.unionByName(met.select(*out)).unionByName(tops.select(*out))


def conversation_trie(df: DataFrame, family: int = 20, shared: int = 4, **names: str) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table of turns."""
    return prefix_trie(rebuilt(settled(conversation_turns(df, **names), "turns"), family, shared))
