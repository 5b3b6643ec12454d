"""The layout ``blobs/{cid}``, ``blobs/{cid}.obao``, ``refs/{path}`` as Spark tables.

Reads go through Spark's file source, so they reach every store that Spark
reaches. Writes go through the ``blocks`` data source. Every task puts its own
objects in place, whole or not at all, so nothing passes through the driver.
Blobs are named by what they hold: a task that runs again writes the same. Refs
of a job that fails may be renewed in part; write them after their objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cairn.functions import blake3
from cairn.functions.cid import cid_of_digest
from cairn.operators.blobs import from_locations
from cairn.sources.config import store_path
from cairn.sources.stores import blob_key, place, ref_key


def read_blobs(spark: SparkSession, uri: str) -> DataFrame:
    """``cid, content, size``; sizes alone never read contents."""
    files = spark.read.format("binaryFile").load(f"{store_path(uri, 'blocks')}/blobs")
    name = F.substring_index("path", "/", -1)
    return files.filter(~name.rlike(r"\.(obao|tmp)$")).select(name.alias("cid"), "content", F.col("length").alias("size"))


def read_outboards(spark: SparkSession, uri: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obao").load(f"{store_path(uri, 'blocks')}/blobs")
    return files.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.obao$", "").alias("cid"), F.col("content").alias("outboard"))


def read_refs(spark: SparkSession, uri: str, prefix: str = "") -> DataFrame:
    """``ref_path, cid`` of the refs under a prefix of whole path parts."""
    base = f"{store_path(uri, 'refs')}/refs"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_extract("path", r"/refs/(.*)$", 1)
    bare = prefix.strip("/")
    found = files.select(path.alias("ref_path"), F.trim(F.decode("content", "UTF-8")).alias("cid"))
    found = found.filter(~F.col("ref_path").endswith(".tmp"))
    return found.filter((F.col("ref_path") == bare) | F.col("ref_path").startswith(f"{bare}/")) if bare else found


def list_folder(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """One level of a folder: ``path, size, modified``."""
    files = spark.read.format("binaryFile").load(path)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if keep is None else out.filter(keep)


def read_locations(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Blobs of several stores; the first store that holds a cid serves it."""
    return from_locations([read_blobs(spark, u) for u in uris])


def write_paths(files: DataFrame, uri: str, batch: int) -> None:
    """``path, content`` into the store: contents are hashed on the way, and an index keeps their paths.

    ``batch`` orders the writes of one path; the largest is the latest.
    """
    spark = files.sparkSession
    register(spark)
    hashed = files.select("path", "content", cid_of_digest(blake3.blake3(F.col("content"))).alias("cid"))
    hashed.select("cid", "content").write.format("blocks").option("uri", uri).mode("append").save()
    index = hashed.select("path", "cid", F.octet_length("content").cast("long").alias("size"), F.lit(batch).cast("long").alias("batch"))
    index.write.mode("append").parquet(f"{store_path(uri, 'blocks')}/index")


def read_index(spark: SparkSession, uri: str) -> DataFrame:
    """``path, cid, size``: what each path holds now."""
    index = spark.read.parquet(f"{store_path(uri, 'blocks')}/index")
    latest = Window.partitionBy("path").orderBy(F.desc("batch"), "cid")
    return index.withColumn("n", F.row_number().over(latest)).filter("n = 1").select("path", "cid", "size")


def read_paths(spark: SparkSession, uri: str, paths: DataFrame) -> DataFrame:
    """Every ``path`` asked for with its ``cid`` and ``content``, null if it was never written."""
    known = paths.join(read_index(spark, uri), "path", "left")
    return known.join(read_blobs(spark, uri).select("cid", "content"), "cid", "left").select("path", "cid", "content")


@dataclass
class Written(WriterCommitMessage):
    objects: int


class BlocksWriter(DataSourceWriter):
    """Rows ``cid, content[, outboard]`` or ``ref_path, cid`` into a store."""

    def __init__(self, options: dict, columns: list[str]):
        self.uri, self.columns = options.get("uri"), columns
        self.kind = "refs" if "ref_path" in columns else "blocks"
        store_path(self.uri, self.kind)  # fails before any task starts

    def write(self, rows) -> Written:
        at, done = place(self.uri, self.kind), 0
        for row in rows:
            x = dict(zip(self.columns, row))
            if self.kind == "refs":
                at.put(at.path(ref_key(x["ref_path"])), x["cid"].encode())
            else:
                if x.get("outboard") is not None:
                    at.put(at.path(blob_key(x["cid"], ".obao")), x["outboard"])
                at.put(at.path(blob_key(x["cid"])), x["content"])
            done += 1
        return Written(done)


class BlocksDataSource(DataSource):
    """``df.write.format("blocks").option("uri", "blocks+file:///...").mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def writer(self, schema, overwrite):
        return BlocksWriter(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlocksDataSource)
