"""Shared plumbing of the corpus operators: sessions, shared tables, Arrow text access."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all runs on one machine, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation of
    everything before.  Each call takes a new folder, so reruns never collide.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names: other columns, whatever their names, cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def identified_docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keyed_docs`` with ``tag``, an int: even where there is an id, else odd; the other bits are a hash of the text.

    A row without an id takes a hash of its text as its id.  (tag, doc_id) names a row,
    whatever ids there are and whether or not they repeat; rows equal in both are copies.
    """
    own = F.xxhash64("text")
    tag = own.bitwiseAND(0x7FFFFFFE).bitwiseOR(F.col("doc_id").isNull().cast("long")).cast("int").alias("tag")
    return keyed_docs(df, id_col, text_col).select(tag, F.coalesce("doc_id", own).alias("doc_id"), "text")


#: What names a row of ``identified_docs``.
NAME = ["tag", "doc_id"]


def real_id() -> Column:
    """The id as it was given: stand-ins become null again."""
    return F.when(F.col("tag") % 2 == 0, F.col("doc_id")).alias("doc_id")


#: A key is hot if it holds more than one in so many rows: there are no more hot keys than this.
HOT_KEYS = 1000
#: Shares that the rows of a hot key are dealt in.
SHARES = 64


def spread_join(many: DataFrame, few: DataFrame, key: list[str], size: str, deal: Column) -> DataFrame:
    """Inner equi-join where ``few`` has one row a key, and in ``size`` how many rows of ``many`` have it.

    The rows of a hot key are dealt by ``deal`` over ``SHARES`` tasks, each with a copy of
    the key's row of ``few``.  Hot keys are at most ``HOT_KEYS`` (each holds that share of
    the rows), so their list may be broadcast.  Both inputs are settled tables.
    """
    total = few.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = few.where(F.col(size) * HOT_KEYS > total).select(*key).withColumn("_hot", F.lit(True))
    share = F.when(F.col("_hot"), F.pmod(deal, F.lit(SHARES)).cast("int")).otherwise(0)
    left = many.join(F.broadcast(hot), key, "left").withColumn("_share", share).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(F.broadcast(hot), key, "left").withColumn("_share", F.explode(copies)).drop("_hot")
    return left.join(right.hint("merge"), [*key, "_share"]).drop("_share")


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and mark (a hash of the text) name a row; and the text."""
    return keyed_docs(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def first_of_groups(df: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` (all columns) that come first in their group by id (null last), then by mark: one row a group.

    ``named`` is settled, (doc_id, mark, root) of every row.  Rows that share id and mark
    are copies of each other, of which one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = named.groupBy("root").agg(F.min(order).alias("row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = settled(first.select("root", F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"), "n"), "first")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    met = spread_join(named, first, ["root"], "n", F.xxhash64("doc_id", "mark"))
    gone = settled(met.where(~same).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "gone")
    # names of the input's columns cannot clash with these: they live in a struct that ends with the join
    row = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    kept = row.join(gone.hint("merge"), own, "left_anti")
    twice = settled(met.where(same).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, own, "left_anti").unionByName(kept.join(twice, own, "left_semi").dropDuplicates(["doc_id", "mark"]))
    return kept.select("row.*")


def worker_store() -> dict:
    """A dictionary of this Python process: it outlives the task where Spark reuses its workers."""
    return sys.modules.setdefault("tabweave_worker", types.ModuleType("tabweave_worker")).__dict__


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null counts as empty) and the n + 1 offsets into them, without copies."""
    arr = pc.fill_null(col, "").cast(pa.large_binary())
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=arr.offset + len(arr) + 1)[arr.offset :] if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = offsets[0]
    return buf[base : offsets[-1]], offsets - base


def slabs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Split rows into consecutive slabs of at most about ``most`` units (one row may be larger)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and shift), so that sums spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def empty_safe(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
