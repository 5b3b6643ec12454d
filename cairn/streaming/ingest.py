"""Ingest of files: hash, identify, store, describe; in one batch or as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import blake3, metadata, paths
from cairn.functions.cid import cid_of_digest
from cairn.operators import blobs, manifests
from cairn.sources import blocks


def ingest(
    files: DataFrame, produced_at: Column, sample: Column | None = None, process: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``path, content`` to blobs with outboards and output objects with their own cids.

    ``sample`` and ``process`` are maps of metadata over the columns of
    ``files``, whose columns ``keep`` go along. The clock is a parameter, so that
    equal inputs give equal objects.
    """
    none = F.lit(None).cast("map<string,string>")
    hashed = files.withColumns(
        {
            "h": blake3.hash_result(F.col("content")),
            "sample_metadata": none if sample is None else metadata.normalize_map(sample),
            "process_metadata": none if process is None else metadata.normalize_map(process),
        }
    )
    named = hashed.select(
        paths.file_name(F.col("path")).alias("file_name"), "content", cid_of_digest(F.col("h.hash")).alias("data_blob"),
        F.col("h.outboard").alias("outboard"), F.col("h.size").alias("data_size_bytes"), "sample_metadata", "process_metadata",
        *keep,
    ).withColumns({"file_type": metadata.file_type(F.col("file_name")), "produced_at": produced_at})
    coded = manifests.encode_objects(named.withColumn("json", manifests.output_json(named)))
    return coded.select(
        "file_name", "file_type", "content", F.col("data_blob").alias("data_cid"), "outboard", F.col("data_size_bytes").alias("size"),
        "json", F.col("bytes").alias("metadata"), F.col("cid").alias("metadata_cid"), *keep,
    )


def outputs(ingested: DataFrame, run_id: Column, seq: Column) -> DataFrame:
    """``run_id, outputs``: file name to metadata link; of files of one name the last by ``seq``."""
    rows = ingested.select(run_id.alias("run_id"), F.col("file_name").alias("path"), F.col("metadata_cid").alias("cid"), seq.alias("seq"))
    return manifests.outputs_of(rows)


def store(spark: SparkSession, ingested: DataFrame, uri: str) -> None:
    """Data blobs with outboards first, then the objects that link to them."""
    blocks.register(spark)
    data = ingested.select(F.col("data_cid").alias("cid"), "content", "outboard").dropDuplicates(["cid"])
    objects = ingested.select(F.col("metadata_cid").alias("cid"), F.col("metadata").alias("content")).dropDuplicates(["cid"])
    for rows in (data, objects):
        rows.write.format("blocks").option("uri", uri).mode("append").save()


def publish(spark: SparkSession, refs: DataFrame, uri: str) -> None:
    """``ref_path, cid`` after the objects they name."""
    blocks.register(spark)
    refs.select("ref_path", "cid").write.format("blocks").option("uri", uri).mode("append").save()


def watch(spark: SparkSession, folder: str, uri: str, checkpoint: str, produced_at: str):
    """Ingest files as they arrive; a batch that runs again writes the same keys."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        store(df.sparkSession, ingest(df.select("path", "content"), F.lit(produced_at)), uri)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(ingested: DataFrame, stored: DataFrame) -> DataFrame:
    """Data blobs that the store lacks."""
    return blobs.upsert(stored, ingested.select(F.col("data_cid").alias("cid"), "content", "size", "outboard"))
