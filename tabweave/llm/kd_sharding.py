"""Sharding by K-d tree partitioning.

The tree starts with all rows and splits each node at the weighted median of its widest
dimension (range over the range of all rows) until every leaf is one shard of the target
bytes.  A median is found by distributed histograms: Spark sums the weight of 1024
intervals of every node at once, the interval that holds the median is cut again, and so
on until it weighs next to nothing.  Rows that are equal in the dimension are ordered by a
content hash, so rows of equal content stay together; a content so heavy that keeping it
whole would unbalance the shards is split by id.

Nodes, their intervals and their histograms are tables: nothing of them reaches the driver,
and the number of shards is bounded by nothing but their rows.

Nulls: a null text weighs 1 byte; null dimension values are smallest; null ids are rows
like any other.  Repeated rows share a shard and have slots of their own.  An empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import SPACES, settled

BINS = 1024
#: Share of a node's weight that may lie between the wanted and the chosen cut.
TOLERANCE = 1e-4


def _value(dims: list[str]) -> Column:
    """What a row is compared by: the node's widest dimension, then the content hash, then the id's."""
    widest = F.element_at(F.array(*dims), F.col("dim") + 1)
    return F.when(F.col("stage") == 0, widest).when(F.col("stage") == 1, F.col("tie")).otherwise(F.col("one"))


def _open_nodes(meta: DataFrame, dims: list[str], spread: dict[str, float]) -> DataFrame:
    """One row a node that is to be split: its widest dimension, the weight wanted below the cut, and the interval that holds it."""
    ends = [f(c).alias(f"{n}_{c}") for c in [*dims, "tie", "one"] for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = meta.where("shards > 1").groupBy("node", "shards").agg(F.sum("weight").alias("total"), *ends)
    width = F.array(*[(F.col(f"hi_{d}").cast("double") - F.col(f"lo_{d}").cast("double")) / F.lit(spread[d]) for d in dims])
    nodes = nodes.withColumn("dim", (F.array_position(width, F.array_max(width)) - 1).cast("int"))
    pick = lambda n: F.element_at(F.array(*[F.col(f"{n}_{d}") for d in dims]), F.col("dim") + 1)
    want = F.col("total") * F.floor(F.col("shards") / 2) / F.col("shards")
    none = F.lit(None).cast("long")
    return nodes.select(
        "node", "shards", "total", "dim", want.alias("want"), F.lit(0).alias("stage"), F.lit(0).cast("double").alias("below"), pick("lo").alias("lo"), pick("hi").alias("hi"),
        none.alias("first"), none.alias("second"), none.alias("bound"), F.lit(False).alias("upto"), "lo_tie", "hi_tie", "lo_one", "hi_one",
    )


def _narrowed(meta: DataFrame, nodes: DataFrame, dims: list[str]) -> DataFrame:
    """One histogram of every node's interval: the bin that holds the wanted weight is the next interval, or the cut lies at its edge."""
    value, widest = _value(dims), F.element_at(F.array(*dims), F.col("dim") + 1)
    mine = value.between(F.col("lo"), F.col("hi")) & ((F.col("stage") < 1) | (widest == F.col("first"))) & ((F.col("stage") < 2) | (F.col("tie") == F.col("second")))
    # exact where the difference fits a long, so that close values of any size come apart
    apart = lambda x, y: F.coalesce(F.try_subtract(x, y).cast("double"), x.cast("double") - y.cast("double"))
    step = F.greatest(apart(F.col("hi"), F.col("lo")) / BINS, F.lit(1e-300))
    bins = F.least(F.lit(BINS - 1), F.floor(apart(value, F.col("lo")) / step).cast("int"))
    rows = meta.join(nodes, ["node", "shards"]).where(mine).select("node", bins.alias("bin"), value.alias("v"), "weight")
    sums = rows.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("v").alias("least"), F.max("v").alias("most"))
    seen = sums.join(nodes, "node").withColumn("run", F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w"))  # BINS rows a node
    bin_ = F.struct("bin", "w", "least", "most", "run")
    got = seen.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("run") + F.col("w") >= F.col("want"), bin_)), F.max(bin_)).alias("b"))
    both = nodes.join(got, "node")
    one_value = F.col("b.least") == F.col("b.most")
    cut = (F.col("b.w") <= TOLERANCE * F.col("total")) | (one_value & (F.col("stage") == 2))
    end = F.col("b.run") + F.col("b.w") - F.col("want") < F.col("want") - F.col("b.run")  # the nearer edge of the bin
    on = ~cut & one_value  # equal here: rows are told apart by the next column
    return both.select(
        "node", "shards", "total", "dim", "want", (F.col("stage") + on.cast("int")).alias("stage"), F.when(cut, F.col("below")).otherwise(F.col("b.run")).alias("below"),
        F.when(on & (F.col("stage") == 0), F.col("lo_tie")).when(on, F.col("lo_one")).otherwise(F.col("b.least")).alias("lo"),
        F.when(on & (F.col("stage") == 0), F.col("hi_tie")).when(on, F.col("hi_one")).otherwise(F.col("b.most")).alias("hi"),
        F.when(on & (F.col("stage") == 0), F.col("b.least")).otherwise(F.col("first")).alias("first"), F.when(on & (F.col("stage") == 1), F.col("b.least")).otherwise(F.col("second")).alias("second"),
        F.when(cut, F.when(end, F.col("b.most")).otherwise(F.col("b.least"))).alias("bound"), (cut & end).alias("upto"), "lo_tie", "hi_tie", "lo_one", "hi_one",
    )


def _split(meta: DataFrame, cuts: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of the nodes that were cut, dealt to their two children; the rows of leaves as they are."""
    widest, value = F.element_at(F.array(*dims), F.col("dim") + 1), _value(dims)
    below = (value < F.col("bound")) | (F.col("upto") & (value == F.col("bound")))
    second = F.when(F.col("stage") < 2, below).otherwise((F.col("tie") < F.col("second")) | ((F.col("tie") == F.col("second")) & below))
    low = F.when(F.col("stage") < 1, below).otherwise((widest < F.col("first")) | ((widest == F.col("first")) & second))
    half = F.floor(F.col("shards") / 2).cast("int")
    keep = [c for c in meta.columns if c not in ("node", "shards")]
    dealt = meta.join(cuts, ["node", "shards"], "left")
    leaf = F.col("bound").isNull()
    node, shards = F.when(leaf | low, F.col("node")).otherwise(F.col("node") + half), F.when(leaf, F.col("shards")).when(low, half).otherwise(F.col("shards") - half)
    return dealt.select(*keep, node.alias("node"), shards.alias("shards"))


def kd_leaves(meta: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``meta`` (weight, tie, one and the dimensions, all long) with ``node``, the leaf of each row: 0 to ``shards`` - 1.

    A node stands for as many shards as are still to come of it; each level halves them.
    """
    ends = meta.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spread = {d: float(max(1, (ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0))) for d in dims}
    now = meta.withColumns({"node": F.lit(0), "shards": F.lit(shards)})
    for _ in range(max(0, shards - 1).bit_length()):
        nodes, cuts = settled(_open_nodes(now, dims, spread), "nodes"), None
        while not nodes.isEmpty():
            nodes = settled(_narrowed(now, nodes, dims), "nodes")
            done = nodes.where("bound is not null")
            cuts = done if cuts is None else cuts.unionByName(done)
            nodes = nodes.where("bound is null")
        if cuts is None:
            break
        now = settled(_split(now, cuts.select("node", "shards", "dim", "stage", "first", "second", "bound", "upto"), dims), "level")
    return now


def numbered(df: DataFrame, group: str, order: list[str], rows: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, counted in hashed buckets so that no group is one task's work."""
    buckets = max(64, min(65536, rows // 10_000))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy(group).orderBy("_b")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1)
    return ranked.join(base.hint("shuffle_hash"), [group, "_b"]).withColumn(out, F.col("_r") + F.col("base")).drop("_b", "_r", "base")


def metadata(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """The narrow table that the tree is built on: id, weight, text checksum, ties, and the dimensions as longs.

    By default the dimensions come from the text itself (bytes, bytes beyond one a
    character, words, lines), so that equal texts have equal places.
    """
    text = F.col(text_col).cast("string")
    dims = dims or {
        "d_bytes": F.octet_length(text),
        "d_wide": F.octet_length(text) - F.length(text),
        "d_blanks": F.length(text) - F.length(F.translate(text, SPACES, "")),
        "d_lines": F.length(text) - F.length(F.translate(text, "\n", "")),
    }
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("weight"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"),
        F.xxhash64(F.col(id_col).cast("string")).alias("one"),
        *[F.coalesce(c.cast("long"), F.lit(-1).cast("long")).alias(n) for n, c in dims.items()],
    )


def kd_sharding(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """Deal all rows to ``shards`` shards of near equal bytes (or as many as ``target_bytes`` asks for).

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in each shard).
    """
    meta = settled(metadata(df, id_col, text_col, dims), "metadata")
    names = [c for c in meta.columns if c not in ("doc_id", "weight", "text_crc32", "tie", "one")]
    rows, total = meta.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    shards = shards or max(1, -(-total // (target_bytes or 1 << 30)))
    leaves = kd_leaves(meta, names, shards)
    dealt = leaves.select("doc_id", F.col("weight").alias("size"), "text_crc32", "tie", F.col("node").alias("shard"))
    return numbered(dealt, "shard", ["doc_id", "tie"], rows, "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
