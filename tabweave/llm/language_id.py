"""Language ID by multilingual mixture inference.

Learning counts hashed letter trigrams of every labelled text, by language.  A text is then
a mixture of languages: expectation-maximisation estimates its proportions from the
trigram likelihoods, and backward elimination keeps the language set whose likelihood,
less a penalty per language, is best.  The prediction is the set's largest share.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with null
language teach nothing.  Without any labelled row every text is ``und``.  Long texts are
read whole.  Repeated rows are predicted alike.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import slabs, text_bytes

#: Trigram hash buckets; the model's size is this times the number of languages.
BUCKETS = 1 << 15
#: Bytes of text worked on at once.
SLAB = 1 << 18
SMOOTH = 0.1


@dataclass
class Model:
    """Languages, and the natural logarithm of each bucket's probability in each of them."""

    langs: list[str]
    logp: np.ndarray


def _letters() -> np.ndarray:
    """Bytes to lower-case letters; bytes of longer characters stay, all else becomes a blank."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    low = np.arange(ord("a"), ord("z") + 1)
    table[low] = low
    table[low - 32] = low
    return table


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every trigram whose middle is part of a word."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint8)
    at = np.arange(len(data)) + 2 * row + 1
    padded[at] = _letters()[data]
    middle = padded[at] != 32
    at, row = at[middle], row[middle]
    code = (padded[at - 1].astype(np.uint32) << np.uint32(16)) | (padded[at].astype(np.uint32) << np.uint32(8)) | padded[at + 1]
    return row, (code * np.uint32(2654435769)) >> np.uint32(17)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams of all rows with a language; Spark adds up what each task has counted."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            coded = batch.column(1).dictionary_encode()
            names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for lo, hi in slabs(offsets, SLAB):
                row, bucket = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                owner = which[lo:hi][row].astype(np.int64)
                got = np.bincount(owner * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + got[k]
        for name, got in sums.items():
            b = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(got[b])], names=["lang", "bucket", "n"])

    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    total = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = total.toPandas()  # languages times buckets at most
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    for k, name in enumerate(langs):
        own = found[found["lang"] == name]
        counts[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T.copy() if langs else np.zeros((BUCKETS, 0), np.float32))


def mixture(row: np.ndarray, bucket: np.ndarray, n: int, logp: np.ndarray, steps: int = 10, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and the chosen sets, for texts given by their trigrams.

    Each elimination round runs ``steps`` of expectation-maximisation over all texts at
    once, scores the sets by log likelihood less ``penalty`` * log(trigrams) a language, and
    takes the smallest share out.
    """
    langs = logp.shape[1]
    key, weight = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    doc, b = key // BUCKETS, key % BUCKETS
    like = logp[b]
    top = like.max(axis=1)
    like = np.exp(like - top[:, None])
    present, first = np.unique(doc, return_index=True)
    size = np.add.reduceat(weight, first).astype(float)
    base = np.add.reduceat(weight * top.astype(float), first)
    local = np.repeat(np.arange(len(present)), np.diff(np.append(first, len(doc))))
    active = np.ones((len(present), langs), bool)
    best = np.full(len(present), -np.inf)
    share_out, set_out = np.zeros((n, langs)), np.zeros((n, langs), bool)
    share = active / langs
    for left in range(langs, 0, -1):
        for _ in range(steps if left > 1 else 0):
            joint = like * share.astype(np.float32)[local]
            joint *= (weight / joint.sum(axis=1))[:, None]
            share = np.add.reduceat(joint, first, axis=0) / size[:, None]
        value = base + np.add.reduceat(weight * np.log(np.maximum((like * share.astype(np.float32)[local]).sum(axis=1), 1e-30)), first)
        value -= penalty * active.sum(axis=1) * np.log(size + 1)
        better = value > best
        best[better] = value[better]
        share_out[present[better]] = share[better]
        set_out[present[better]] = active[better]
        if left > 1:
            worst = np.where(active, share, np.inf).argmin(axis=1)
            active[np.arange(len(present)), worst] = False
            share = np.where(active, share + 1e-9, 0)
            share /= share.sum(axis=1, keepdims=True)
    return share_out, set_out


def judge(data: np.ndarray, offsets: np.ndarray, langs: list[str], logp: np.ndarray, penalty: float) -> tuple[list, list, list, list]:
    """Of each text the predicted language, its share, and the chosen set with its shares, largest first."""
    names, scores, sets, shares = [], [], [], []
    for lo, hi in slabs(offsets, SLAB):
        row, bucket = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        known = np.bincount(row, minlength=hi - lo) > 0
        if langs and len(row):
            share, chosen = mixture(row, bucket, hi - lo, logp, penalty=penalty)
        for k in range(hi - lo):
            text = data[offsets[lo + k] : offsets[lo + k + 1]]
            if not (langs and known[k]) or (text >= 128).any() and not has_letter(text):
                names.append("und")
                scores.append(0.0)
                sets.append([])
                shares.append([])
                continue
            best = int(share[k].argmax())
            inside = sorted(np.flatnonzero(chosen[k]).tolist(), key=lambda j: -share[k, j])
            names.append(langs[best])
            scores.append(min(1.0, float(share[k, best])))
            sets.append([langs[j] for j in inside])
            shares.append([float(share[k, j]) for j in inside])
    return names, scores, sets, shares


def identified(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """The rows of ``df`` (all columns) whose text is in a learned language by a share of ``least`` or more."""
    langs, logp, at = model.langs, df.sparkSession.sparkContext.broadcast(model.logp), df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            names, scores, _, _ = judge(*text_bytes(batch.column(at)), langs, logp.value, penalty)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score (the share of that language), langs (the chosen set), shares (theirs)."""
    langs, logp = model.langs, df.sparkSession.sparkContext.broadcast(model.logp)  # languages times buckets

    def infer(batches):
        for batch in batches:
            names, scores, sets, shares = judge(*text_bytes(batch.column(1)), langs, logp.value, penalty)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(infer, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def has_letter(text: np.ndarray) -> bool:
    """Whether the text has a letter; only bytes above ASCII need decoding, and the first letter ends the search."""
    ascii_letter = ((text | 32) >= 97) & ((text | 32) <= 122)
    return bool(ascii_letter.any()) or any(c.isalpha() for c in text.tobytes().decode("utf-8", "ignore"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """A fifth of the ids, by CRC: their languages are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learn from the labelled rows that are not held out, predict all: doc_id, held_out, lang_pred, score, langs, shares."""
    model = fit(df.where(~held_out(id_col, folds)), text_col, lang_col)
    out = predict(df, model, id_col, text_col)
    return out.select("doc_id", held_out("doc_id", folds).alias("held_out"), "lang_pred", "score", "langs", "shares")
