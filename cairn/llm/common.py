"""Helpers that the operators share: inputs, checkpoints, scratch tables."""

from __future__ import annotations

import contextlib
import gc
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import checkpoint, checkpoint_dir

#: Word separators: space and the five ASCII control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def once(col: Column) -> Column:
    """``col``, computed in the projection that holds it and nowhere else.

    The optimiser copies a filter's inputs below the projections that make them;
    with long chains those copies multiply. It leaves non-deterministic columns
    where they are.
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, *strings: str) -> bool:
    """Whether a kept table is small enough to broadcast: its text columns ``strings``, and 64 bytes a row."""
    size = sum((F.coalesce(F.octet_length(s), F.lit(0)) for s in strings), F.lit(64).cast("long"))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


class Scratch:
    """Parquet tables in the shared folder for one operator run; ``drop`` or leaving deletes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/cairn-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        free(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        with contextlib.suppress(Exception):
            self.drop()


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished jobs now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes.

    The limits belong to the session and are read when a frame runs, which is
    after an operator has returned it, so they stay; they only ever go down.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.isModifiable(key):
            now = spark.conf.get(key).rstrip("b")
            if not (now.isdigit() and 0 < int(now) <= most):
                spark.conf.set(key, str(most))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    name = "_cairn_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
