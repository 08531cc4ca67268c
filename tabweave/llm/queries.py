"""The registered queries of the corpus operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, core, decontamination, kd_sharding, language_id, oracles, packing, pii_sanitiser, prefix_trie, quality_rules, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, url_filter


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_sharding.kd_sharding(core.documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.quality_rules(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged


def op3_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(core.documents(spark, sf_dir))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_id(core.documents(spark, sf_dir))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(core.documents(spark, sf_dir), shingle=3, radius=2)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(core.documents(spark, sf_dir), n=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op7_pii_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitiser.pii_sanitiser(core.documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(core.documents(spark, sf_dir), n=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(core.documents(spark, sf_dir), benchmark)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies; the package that names it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(core.documents(spark, sf_dir), tokenizer_path(), capacity=2048, keep_ids=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), family=20, shared=4)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(core.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_entropy": op3_secret_entropy,
    "op4_language_mixture": op4_language_mixture,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii_sanitiser": op7_pii_sanitiser,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filter": op12_url_filter,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

#: The other queries learn from the data, tokenise, or hash in ways that SQL does not have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
}
