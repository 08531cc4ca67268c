"""PII: information-theoretic sanitisation, in DataFrame functions only.

Protected entities are matches of fixed patterns.  Terms near them may give them away:
with document counts over the corpus, a term reveals the share
``log2(N n(e, t) / (n(e) n(t))) / log2(N / n(e))`` of an entity's information (pointwise
mutual information over information content).  Terms above a threshold are generalised,
terms that reveal nearly all of it are removed.

Match places come from the lengths of the matches and of the text between them.

Nulls: a null text is empty.  Rows are told apart by their place in the table, so null
or repeated ids are rows of their own.  An empty table gives no rows.  Texts are read
whole; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import settled, spread_join

#: Fixed patterns (values given by the data contract), in the order in which kinds are
#: listed.  A match starts where the last ended or where no longer run precedes it, and
#: runs are possessive: same matches, in time that grows with the text only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: Without this in a text there is no match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Code points on either side of an entity whose words are its context.
CONTEXT = 60
#: A term's revealed share from which it is generalised, or removed, and the documents it takes to tell.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 2
_CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    worth = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)) * 2 - F.when(F.coalesce(c.try_cast("int"), F.lit(0)) > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda x, y: x + y) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~m.rlike(r"(^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(\.|$)")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda x: valid(kind, x["value"])


def with_spans(rows: DataFrame) -> DataFrame:
    """Add ``base``: the valid matches of all kinds as (start, kind number, end, value), by start, then kind."""
    for kind, pattern in PATTERNS.items():
        has = F.col("t").rlike(NEEDS[kind])
        none = F.array().cast("array<string>")
        rows = rows.withColumn(f"m_{kind}", F.when(has, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        m = F.col(f"m_{kind}")
        rows = rows.withColumn("g", F.when(F.size(m) > 0, F.split("t", pattern)).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn("step", F.zip_with(F.slice("g", 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))
        add = lambda x, y: x + y
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size("step") / _CHUNK).cast("int")), lambda c: F.aggregate(F.slice("step", c * _CHUNK + 1, F.lit(_CHUNK)), F.lit(0), add))
        rows = rows.withColumn("sums", sums)
        heads = F.transform("sums", lambda s, c: F.aggregate(F.slice("sums", F.lit(1), c), F.lit(0), add))
        rows = rows.withColumn("heads", heads).drop("sums")
        stop = lambda i: F.get("heads", F.floor(i / _CHUNK).cast("int")) + F.aggregate(F.slice("step", F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK + 1), F.lit(0), add)
        spans = F.transform(m, lambda x, i: F.struct((stop(i) - F.length(x)).alias("start"), F.lit(k).alias("kind"), stop(i).alias("end"), x.alias("value")))
        rows = rows.withColumn(f"s_{kind}", F.when(F.size(m) > 0, F.filter(spans, _passes(kind))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")))
        rows = rows.drop("g", "step", "heads", f"m_{kind}")
    return rows.withColumn("base", F.array_sort(F.concat(*[F.col(f"s_{kind}") for kind in PATTERNS])))


def _words(context: Column, at: Column, skip_first: Column, skip_last: Column) -> Column:
    """Words of four letters or more of a short context that starts at ``at``: (term, start, end)."""
    parts = F.split(context, r"[^\p{L}]")  # one sign each: the pieces and their number give the places
    place = lambda k: at + F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda x, w: x + F.length(w) + 1)
    every = F.transform(parts, lambda w, k: F.when((F.length(w) >= 4) & ~((k == 0) & skip_first) & ~((k == F.size(parts) - 1) & skip_last), F.struct(F.lower(w).alias("term"), place(k).alias("start"), (place(k) + F.length(w)).alias("end"))))
    return F.filter(every, lambda x: x.isNotNull())


def contexts(rows: DataFrame) -> DataFrame:
    """Add ``near``: for every entity the words around it, as (entity, term, start, end)."""
    total = F.length("t")

    def around(x: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), x["start"] - CONTEXT), F.least(total, x["end"] + CONTEXT)
        left = _words(F.substring(F.col("t"), lo + 1, x["start"] - lo), lo, lo > 0, F.lit(True))
        right = _words(F.substring(F.col("t"), x["end"] + 1, hi - x["end"]), x["end"], F.lit(True), hi < total)
        return F.transform(F.concat(left, right), lambda w: F.struct(F.lower(x["value"]).alias("entity"), w["term"].alias("term"), w["start"].alias("start"), w["end"].alias("end")))

    return rows.withColumn("near", F.when(F.size("base") > 0, F.flatten(F.transform("base", around))))


def term_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): in how many texts of the corpus each word of four letters or more stands."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+"))
    return df.select(F.explode(words).alias("term")).where(F.length("term") >= 4).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing(near: DataFrame, terms: DataFrame, total: int, entities: DataFrame) -> DataFrame:
    """(entity, term, n_et, share): the pairs that pass the threshold.  ``near`` is (rid, entity, term), one row a place."""
    pairs = near.select("rid", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= SUPPORT)
    share = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    return (
        pairs.join(entities, "entity").join(terms.hint("merge"), "term").where(F.col("n_e") < total)
        .select("entity", "term", "n_et", share.alias("share")).where(F.col("share") >= GENERALISE)
    )


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_sanitiser(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and clean_text if asked for.

    Spans are kind:start:end in code points, by start, then kind; kind ``term`` marks words
    that reveal an entity near them.  In clean_text entities and removed terms become their
    kind in brackets, generalised terms their first letter and an ellipsis.
    """
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    scanned = contexts(with_spans(rows))
    scanned = settled(scanned.select("rid", "doc_id", *(["t"] if keep_text else []), *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], "base", "near"), "scanned")
    total = scanned.count()
    near = scanned.where("near is not null").select("rid", F.explode("near").alias("x")).select("rid", "x.*")
    entities = scanned.where("size(base) > 0").select("rid", F.explode(F.array_distinct(F.transform("base", lambda x: F.lower(x["value"])))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    flagged = settled(disclosing(near, term_documents(df, text_col), total, entities), "flagged")
    hits = spread_join(near, flagged, ["entity", "term"], "n_et", F.xxhash64("rid", "start")).groupBy("rid", "start", "end").agg(F.max("share").alias("share"))
    lists = settled(hits.groupBy("rid").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("end"), F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("value"))).alias("terms")), "terms")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    out = scanned.join(lists.hint("merge"), "rid", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("terms", none))))
    cols = ["doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("all")).alias("spans")]
    return out.select(*cols, *([_clean().alias("clean_text")] if keep_text else []))


def _clean() -> Column:
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, x: Column) -> Column:
        first = F.substring(F.col("t"), x["start"] + 1, F.lit(1))
        mark = F.when(x["value"] == "generalise", F.concat(first, F.lit("…"))).otherwise(F.get(names, x["kind"]))
        # a span inside the last one adds nothing, one that overlaps it only lengthens it
        added = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, x["start"] - acc["at"]), mark)).otherwise(acc["out"])
        return F.struct(added.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate("all", start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t") + 1)))
