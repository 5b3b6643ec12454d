"""Blob relations: ``cid, content, size, outboard`` rows keyed by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exists(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    """Keys that are stored."""
    return keys.join(blobs.select("cid"), "cid", "left_semi")


def missing(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    return keys.join(blobs.select("cid"), "cid", "left_anti")


def sizes(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every key with its blob's size, -1 if there is none."""
    return keys.join(blobs.select("cid", "size"), "cid", "left").withColumn("size", F.coalesce("size", F.lit(-1)))


def lookup(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every key with content and outboard, null if there is none."""
    return keys.join(blobs, "cid", "left")


def upsert(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: one per new content that is not stored yet."""
    return new.dropDuplicates(["cid"]).join(blobs.select("cid"), "cid", "left_anti")


def delete(blobs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs left, every key with whether it existed)."""
    gone = keys.select("cid").distinct()
    found = gone.join(blobs.select("cid").distinct().withColumn("hit", F.lit(True)), "cid", "left")
    return blobs.join(gone, "cid", "left_anti"), found.select("cid", F.col("hit").isNotNull().alias("existed"))


def from_locations(locations: list[DataFrame]) -> DataFrame:
    """One row per cid: from the first location, in order, that holds it."""
    tagged = [df.withColumn("location", F.lit(k)) for k, df in enumerate(locations)]
    every = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in every.columns if c != "cid"]
    best = every.groupBy("cid").agg(F.min_by(F.struct(*rest), "location").alias("x"))
    return best.select("cid", *(F.col(f"x.{c}") for c in rest))


def dedupe_stats(blobs: DataFrame) -> DataFrame:
    """Per cid: copies, its size, and the bytes that storing it once saves."""
    return blobs.groupBy("cid").agg(F.count("*").alias("copies"), F.max("size").alias("size")).withColumn(
        "saved", (F.col("copies") - 1) * F.col("size")
    )
