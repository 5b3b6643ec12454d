"""The registered queries of the operators in this folder, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ann, byte_bpe, html_text, kd_sharding, packing, pii, quality_eb, quality_rules, simhash, suffix_dedup
from cairn.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_eb.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans",
        "n_terms", "n_generalised", "n_removed", "n_spans",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_quality_eb, op2_ann, op3_pii, op4_packing, op5_suffix_dedup, op6_quality_rules, op7_simhash,
            op8_html_text, op9_kd_sharding, op10_byte_bpe,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_pii": pii.oracle(), "op5_suffix_dedup": suffix_dedup.oracle(), "op6_quality_rules": quality_rules.oracle(), "op7_simhash": simhash.oracle(), "op9_kd_sharding": kd_sharding.oracle()}
