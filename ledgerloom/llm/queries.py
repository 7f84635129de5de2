"""The registered queries of this subpackage, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, chat, forest, mixture, near, periodic, quality, sharding, spans, spelling, suffix, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def word_vocabulary() -> str:
    """Place of the public word-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), word_vocabulary())


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.exchanges(_table(spark, sf_dir, "conversations")), chat.REPLY)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated(_table(spark, sf_dir, "documents"))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixture.mix(_table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), changed=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_digests(_table(spark, sf_dir, "documents"), word_vocabulary())


REGISTERED = {
    "op1_order_minhash": op1_order_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_tool_calls": op4_tool_calls,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_hash_prefix_forest": op9_hash_prefix_forest,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
