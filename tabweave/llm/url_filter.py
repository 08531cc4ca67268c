"""URL filter: rules first, then naive Bayes over the words that host and path fall apart into.

Rules name a host (with all its subdomains) and the start of a path; the longest that fits
decides.  All other urls are judged by their words:

* host and path are cut into runs of letters, and each run is split into words by a unigram
  model: Viterbi over all splits, a word's cost being the negative log of its share.  Words
  are counted in the visible text of all pages, in paths, and where hosts themselves mark
  them: between hyphens, or as a whole label of several hosts.  An unknown word has a tenth
  of a single count's share for each further letter;
* a url is taught to be blocked if a seed word is among the words of its host, else allowed
  (seeds are a parameter: they are all that is given, the rest is learned from what stands
  beside them);
* class counts of words over all urls give smoothed log odds; a url is blocked if their
  sum, with the classes' shares as the prior, is above zero.

Runs are split once each, however many urls hold them.  Which known words lie in a run is a
join of the run's substrings with the words that occur as such substrings, so no vocabulary
is broadcast and none has to fit in a worker.  Equal urls are judged once; a url, host or
run with a large part of all rows is spread.

Nulls: a null url is empty, and a url without ``://`` has empty host and path; both have no
word, so the prior decides.  Rows with null or repeated ids stay rows of their own.  Runs of
any length are split (a word has at most 24 letters).  An empty table gives no rows.  Only
the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import empty_safe, settled, spread_join

#: Letters of a known word at most.
LONGEST = 24
#: A run of letters is one piece of a url; digits between signs are one word whatever they are.
RUN = r"\p{L}+|0"
NUMBER = "0"
#: Host words that teach the classifier what to block, if the caller has none of their own.
SEEDS = ("casino", "pills", "adult", "spam", "bets", "ads", "porn", "viagra", "warez", "malware")
#: Rules of ``op12``: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``) of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"\A([^?#]*)", 1)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule, verdict = F.when(fits, on + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def runs_of(text: Column) -> Column:
    """Runs of letters, lower-cased, and ``NUMBER`` for each run of digits."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[0-9]+", NUMBER)), F.lit(RUN), F.lit(0))


def visible_words(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): lower-cased words of all pages' text, without scripts, styles, comments and tags."""
    # what is not closed ends with the page, so each character is read once
    text = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\b|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def marked_words(hosts: DataFrame) -> DataFrame:
    """(word, n): runs that distinct ``hosts`` mark as words: between hyphens, once a host; as a whole label, once a host beyond the first."""
    labels = hosts.select("host", F.explode(F.split("host", r"\.")).alias("label"))
    parts = labels.select("host", F.col("label").contains("-").cast("long").alias("hyphen"), F.explode(runs_of(F.col("label"))).alias("word"))
    counted = parts.groupBy("host", "word").agg(F.max("hyphen").alias("hyphen")).groupBy("word").agg(F.sum("hyphen").alias("split"), F.count(F.lit(1)).alias("hosts"))
    return counted.select("word", F.greatest("split", F.col("hosts") - 1).alias("n")).where("n > 0")


def split_run(run: str, costs: dict[tuple[int, int], float], unknown: tuple[float, float]) -> list[str]:
    """The cheapest split of ``run``: ``costs`` by (start, length) of known words; of equal ones that with the longest last word.

    An unknown word of l letters costs unknown[0] + l * unknown[1].
    """
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - LONGEST), end):
            cost = best[start] + costs.get((start, end - start), unknown[0] + (end - start) * unknown[1])
            if cost < best[end] - 1e-12:
                best[end], back[end] = cost, start
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def _split(total: int, shape: pa.Schema):
    unknown = (math.log(max(1, total)) - math.log(10.0), math.log(10.0))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for run, known in zip(batch["run"].to_pylist(), batch["known"].to_pylist()):
                costs = {(k["start"], k["size"]): math.log(max(1, total)) - math.log(k["n"]) for k in known or ()}
                words.append(split_run(run, costs, unknown))
            yield pa.RecordBatch.from_arrays([batch["run"], pa.array(words, pa.list_(pa.string()))], schema=shape)

    return told


def segmented(runs: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(run, words) of distinct ``runs`` by the unigram model ``unigrams`` (word, n): numbers stay one word.

    Unknown words are dearer than any known one: a share of 1 / total, less by ten a letter.
    """
    spark = runs.sparkSession
    letters = runs.where(F.col("run").rlike(r"\A\p{L}"))
    chars = F.length("run")
    starts = letters.select("run", F.explode(F.sequence(F.lit(0), chars - 1)).alias("start"))
    spans = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), chars - F.col("start")))).alias("size"))
    spans = settled(spans.select("run", "start", "size", F.substring("run", F.col("start") + 1, F.col("size")).alias("word")), "spans")
    total = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = settled(spans.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).join(unigrams, "word"), "known")
    met = spread_join(spans, known, ["word"], "rows", F.xxhash64("run"))
    lists = met.groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))
    shape = empty_safe(spark.createDataFrame([], "run string, words array<string>").schema)
    split = letters.join(lists, "run", "left").select("run", "known").mapInArrow(_split(total, shape), "run string, words array<string>")
    return split.unionByName(runs.where(~F.col("run").rlike(r"\A\p{L}")).select("run", F.array(F.lit(NUMBER)).alias("words")))


def judged_urls(urls: DataFrame, unigrams: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(key, host, path, n, score, words): log odds of being blocked for distinct ``urls`` (key, host, path, n rows of the pages).

    ``words`` are the host's.  Class counts weigh a url by its rows.
    """
    spark = urls.sparkSession
    urls = settled(urls, "urls")
    hosts = settled(urls.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls")), "hosts")
    host_runs = settled(hosts.select("host", F.posexplode(runs_of(F.col("host"))).alias("pos", "run")), "host_runs")
    path_runs = settled(urls.select("key", "host", "n", F.explode(runs_of(F.col("path"))).alias("run")), "path_runs")
    in_paths = settled(path_runs.groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "in_paths")
    in_hosts = settled(host_runs.groupBy("run").agg(F.count(F.lit(1)).alias("rows")), "in_hosts")
    seeded = spark.createDataFrame([(s, 1) for s in seeds], "word string, n long")
    model = unigrams.unionByName(in_paths.select(F.col("run").alias("word"), "n")).unionByName(marked_words(hosts)).unionByName(seeded)
    model = settled(model.where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n")), "model")
    split = settled(segmented(in_paths.select("run").unionByName(in_hosts.select("run")).distinct(), model), "segmented")

    # hosts: their words, and whether a seed is among them
    met = settled(spread_join(host_runs, settled(split.join(in_hosts, "run"), "host_split"), ["run"], "rows", F.xxhash64("host")), "host_words")
    taught = met.groupBy("host").agg(F.max(F.exists("words", lambda w: w.isin(*seeds))).alias("blocked"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    none = F.array().cast("array<string>")
    hosts = settled(hosts.join(taught, "host", "left").withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "words": F.coalesce("words", none)}), "taught")

    # class counts of words: hosts by their rows, path runs by run and class first
    path_class = spread_join(path_runs, hosts.select("host", "blocked", "urls"), ["host"], "urls", F.xxhash64("key"))
    by_run = path_class.groupBy("run", "blocked").agg(F.sum("n").alias("n")).join(split, "run").select("blocked", "n", F.explode("words").alias("word"))
    by_word = hosts.select("blocked", "n", F.explode("words").alias("word")).unionByName(by_run).groupBy("word").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("good"))
    by_word = settled(by_word, "class_counts")
    bad, good, words = by_word.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    n_bad, n_all = hosts.agg(F.coalesce(F.sum(F.when(F.col("blocked"), F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 1) / F.lit(bad + words + 1)) - F.log((F.col("good") + 1) / F.lit(good + words + 1))
    prior = math.log(n_bad + 1) - math.log(n_all - n_bad + 1)

    # a run's odds are the sum of its words'; a url's those of its host and its path's runs
    weight = split.select("run", F.explode("words").alias("word")).join(by_word.select("word", odds.alias("odds")), "word").groupBy("run").agg(F.sum("odds").alias("odds"))
    weight = settled(weight, "run_odds")
    path_weight = settled(weight.join(in_paths.select("run", "rows"), "run"), "path_odds")
    host_weight = settled(weight.join(in_hosts, "run"), "host_odds")
    paths = spread_join(path_runs, path_weight, ["run"], "rows", F.xxhash64("key")).groupBy("key").agg(F.sum("odds").alias("path_odds"))
    host_odds = spread_join(host_runs, host_weight, ["run"], "rows", F.xxhash64("host")).groupBy("host").agg(F.sum("odds").alias("host_odds"))
    scored = settled(hosts.select("host", "urls", "words").join(host_odds, "host", "left"), "scored")
    joined = spread_join(urls, scored, ["host"], "urls", F.xxhash64("key")).join(paths, "key", "left")
    score = F.round(F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)), 6)
    return joined.select("key", "host", "path", "n", score.alias("score"), "words")


def url_filter(pages: DataFrame, seeds: Sequence[str] = SEEDS, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (log odds of being blocked), host_words."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("key")
    host, path = host_and_path(F.col("key"))
    urls = pages.select(url).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", host.alias("host"), path.alias("path"), "n")
    unigrams = settled(visible_words(pages.select(html_col), html_col), "unigrams")
    judged = judged_urls(urls, unigrams, seeds)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))
    told = settled(judged.select("key", "host", "path", "n", rule.alias("rule"), verdict.alias("verdict"), "score", F.col("words").alias("host_words")), "judged")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url)
    # a url in a large part of all rows is spread; rows differ by their ids
    return spread_join(rows, told, ["key"], "n", F.xxhash64(F.coalesce("page_id", F.lit(0)))).select("page_id", "host", "path", "rule", "verdict", "score", "host_words")
