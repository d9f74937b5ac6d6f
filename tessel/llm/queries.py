"""The queries of the training-data operators, by name, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import alignment, chat, exact_dedup, line_dedup, lm, minhash, mixing, phrases, quality_rules, repeats, sharding, subwords, token_files
from tessel.llm.oracles import ORACLES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    failed = ~quality_rules.passes(F.col("fail_bits"), quality_rules.BASE)
    return quality_rules.apply_policy(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "n_letters", "fail_bits")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.round_trips(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written(documents(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat.with_trial(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.read(chat.windows(talks)))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(phrases.phrases(documents(spark, sf_dir)))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op6_mixing": op6_mixing,
    "op8_minhash": op8_minhash,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_line_dedup": op7_line_dedup,
    "op9_repeats": op9_repeats,
    "op10_token_files": op10_token_files,
    "op11_chat": op11_chat,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}
