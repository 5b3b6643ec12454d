"""The corpus pipeline: five stages over ``documents``, each written and read again by its caller.

Every function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``docs``, whatever further ones there are.

Defined results: a null, empty or word-free text is rejected by the first stage;
of documents of one near-duplicate group the smallest id stays, of rows that repeat
id and text one, and null ids come after all others; a character that a removed
passage cuts into goes with it; a text without personal data is not changed by the
fourth stage; a text that lost everything is packed as the end id alone; texts are
read whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import packing, pii, quality_rules, simhash, suffix_dedup
from cairn.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; what remains of a text replaces it."""
    return suffix_dedup.cut_texts(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced."""
    return pii.sanitise_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeats),
    ("pii", private),
    ("packing", pack),
]

#: SimHash components, suffix arrays and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    The last of these tables stays there, as the result reads it; a failure leaves none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = scratch.keep(name, docs)
                if k:
                    scratch.drop(STAGES[k - 1][0])
    except BaseException:
        scratch.drop()
        raise
    return docs
