"""op1, op2, the pipeline, and the registered queries' columns."""

import zlib
from collections import Counter

import pytest

from tabweave.llm import kd_sharding, quality_rules, queries


def brute_counts(t):
    t = t or ""
    w = t.encode().split()
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    m = [0] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            m[i : i + 8] = [1] * 8
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(m)


def test_statistics_match_brute_force(docs, plain, odd, odd_rows):
    for df, rows in ((docs, list(plain.items())), (odd, [(d, t) for d, t, _ in odd_rows])):
        got = Counter(tuple(r) for r in quality_rules.statistics(df).select("doc_id", *quality_rules.BASE).collect())
        assert got == Counter((d, *brute_counts(t)) for d, t in rows)


def test_list_separates_and_keeps(spark, docs):
    """Learned from labels that follow a rule, the list drops what the rule says and little else."""
    labels = docs.selectExpr("doc_id", "CASE WHEN length(text) - length(translate(text, '#*$%&|<>', '')) > 5 THEN 0 ELSE 1 END AS quality")
    judged, rules = quality_rules.quality_rules(docs, labels, least_rows=1)
    rows = {r["doc_id"]: r for r in judged.collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    good = [d for d, q in truth.items() if q == 1 and not rows[d]["base_failed"]]
    bad = [d for d, q in truth.items() if q == 0 and not rows[d]["base_failed"]]
    assert sum(rows[d]["kept"] for d in good) >= 0.97 * len(good)
    assert rules.rules and sum(rows[d]["kept"] for d in bad) <= 0.2 * len(bad)
    for r in rows.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and (r["kept"] or r["base_failed"] or r["rule"] is not None)


def test_no_labels_no_rules(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality_rules.quality_rules(odd, none)
    assert not rules.rules and all(r["kept"] != r["base_failed"] for r in judged.collect())
    assert quality_rules.quality_rules(empty, none)[0].count() == 0
    odd_labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (5, 1)], none.schema)
    assert quality_rules.quality_rules(odd, odd_labels)[0].count() == odd.count()


def check_shards(rows, texts, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return {k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)}


def test_shards_are_even(docs, plain):
    sizes = check_shards(kd_sharding.kd_sharding(docs, 8).collect(), list(plain.items()), 8)
    mean, largest = sum(sizes.values()) / 8, max(len(t.encode()) for t in plain.values())
    assert all(abs(s - mean) <= largest for s in sizes.values())


def test_a_heavy_content_is_split(spark):
    """A third of the rows share one text: shards stay even."""
    rows = [(i, "same text " * 40 if i % 3 == 0 else f"text {i} " * (20 + i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = check_shards(kd_sharding.kd_sharding(df, 5).collect(), rows, 5)
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 5


def test_equal_texts_stay_together_where_they_may(docs):
    shard = {r["doc_id"]: r["shard"] for r in kd_sharding.kd_sharding(docs, 4).collect()}
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"], set()).add(shard[r["doc_id"]])
    assert all(len(s) == 1 for s in groups.values())


def brute_leaves(rows, dims, shards):
    """The same tree, a node at a time: rows in order of (widest dimension, tie, one) are cut where the weight comes nearest to the share."""
    spread = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in dims}
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update({r["doc_id"]: first for r in part})
            return
        widest = max(dims, key=lambda d: (max(r[d] for r in part) - min(r[d] for r in part)) / spread[d])
        part = sorted(part, key=lambda r: (r[widest], r["tie"], r["one"]))
        want, run, k = sum(r["weight"] for r in part) * (n // 2) / n, 0, 0
        while k < len(part) - 1 and run + part[k]["weight"] < want:
            run += part[k]["weight"]
            k += 1
        k += run + part[k]["weight"] - want < want - run
        split(part[:k], first, n // 2)
        split(part[k:], first + n // 2, n - n // 2)

    split(rows, 0, shards)
    return out


def test_tree_matches_brute_force(docs, odd):
    for df, shards in ((docs, 8), (docs, 13), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), 5)):
        meta = kd_sharding.metadata(df).cache()
        dims = [c for c in meta.columns if c.startswith("d_")]
        got = {r["doc_id"]: r["node"] for r in kd_sharding.kd_leaves(meta, dims, shards).collect()}
        assert got == brute_leaves([r.asDict() for r in meta.collect()], dims, shards)


def test_shards_of_odd_rows(odd, odd_rows, empty):
    check_shards(kd_sharding.kd_sharding(odd, 8).collect(), [(d, t) for d, t, _ in odd_rows], 8)
    assert kd_sharding.kd_sharding(empty, 8).count() == 0
    assert kd_sharding.kd_sharding(odd, target_bytes=100_000).select("shard").distinct().count() > 1


CONTRACT = {
    "op1_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_secret_entropy": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_language_mixture": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_pii_sanitiser": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_decontamination": ["doc_id", "item_id"],
    "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query_columns(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.columns[: len(CONTRACT[name])] == CONTRACT[name]


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, sf_dir)
        assert new.columns == docs.columns and new.count() <= now.count()
        now = spark.createDataFrame(new.collect(), docs.schema)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r[0] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in now.collect()}
    from tests.llm.test_scans import brute_secrets

    assert not any(brute_secrets(r["text"]) for r in now.collect())


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd, empty):
    """Null, repeated and very large ids, clashing columns: what becomes of each row, stage by stage."""
    import corpus_pipeline
    from tests.llm.test_near_copies import brute_groups

    stages, rows = dict(corpus_pipeline.STAGES), odd.collect()
    text = lambda rs: sorted(str((r["doc_id"], r["text"])) for r in rs)
    # near copies: of each group the first by id (null last) stays, and rows without an id stay or go by their own text
    label = brute_groups([r["text"] for r in rows])
    first = {}
    for r, g in zip(rows, label):
        k = (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
        first[g] = min(first.get(g, k), k)
    kept = stages["simhash_near_dedup"](spark, odd, sf_dir)
    got = kept.collect()
    assert kept.columns == odd.columns and len(got) == len(first)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(k[:2] for k in first.values())
    assert "all on its own, without an id" in {r["text"] for r in got}
    # by query 5's rule, too, one row of each component stays
    from tabweave.llm import simhash_dedup
    from tests.llm.test_simhash import brute_components, brute_print

    prints = [(k, brute_print(r["text"])) for k, r in enumerate(rows)]
    groups = {c for _, _, c in brute_components(prints, 2)}
    once = simhash_dedup.drop_near_duplicates(odd)
    assert once.columns == odd.columns and once.count() == len(groups)
    # languages that no learned language explains go, each by its own text
    spoken = stages["language_id"](spark, odd, sf_dir)
    assert {r["doc_id"] for r in spoken.collect()} & {1, 2, 3, 9} == set() and spoken.columns == odd.columns
    # secrets: every row stays, only texts that hold one change
    clean = {str((r["doc_id"], r["n_chars"])): r["text"] for r in stages["secret_scan"](spark, odd, sf_dir).collect()}
    assert len(stages["secret_scan"](spark, odd, sf_dir).collect()) == len(rows) and not any("hunter22" in (t or "") for t in clean.values())
    assert text(stages["decontamination"](spark, odd, sf_dir).collect()) == text(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
