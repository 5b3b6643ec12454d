"""Mutable names over an append-only log ``seq, ref_path, cid, op`` (``put`` or ``delete``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import checkpoint


def ref_path(path: Column) -> Column:
    """Without one leading separator; an error for a path that climbs."""
    clean = F.regexp_replace(path, "^/", "")
    return F.when(clean.rlike(r"(^|/)\.\.(/|$)"), F.raise_error(F.lit("ref path climbs")).cast("string")).otherwise(clean)


def workflow_ref(name: Column, branch: str = "latest") -> Column:
    return F.concat(F.lit("workflows/"), name, F.lit(f"/{branch}"))


def project_ref(project: Column) -> Column:
    return F.concat(F.lit("projects/"), project, F.lit("/latest"))


def run_ref(run: Column) -> Column:
    return F.concat(F.lit("runs/"), run)


def sample_ref(sample: Column) -> Column:
    return F.concat(F.lit("samples/"), sample, F.lit("/latest"))


def current(log: DataFrame) -> DataFrame:
    """``ref_path, cid``: the last write of each ref, without deleted ones."""
    last = log.groupBy("ref_path").agg(F.max_by(F.struct("op", "cid"), "seq").alias("x"))
    return last.filter(F.col("x.op") == "put").select("ref_path", "x.cid")


def with_previous(log: DataFrame) -> DataFrame:
    """Every write with the value it replaced, null after a delete or at the start."""
    by = Window.partitionBy("ref_path").orderBy("seq")
    return log.withColumn("previous", F.lag(F.when(F.col("op") == "put", F.col("cid"))).over(by))


def at(batch: Column, position: Column | int = 0) -> Column:
    """The place of a write in a log: a batch of writes, then the place in it.

    One writer hands out batches, so writes are ordered without numbering a log.
    """
    return F.struct(batch.alias("batch"), (position if isinstance(position, Column) else F.lit(position)).alias("position"))


def update(new: DataFrame, batch: Column) -> DataFrame:
    """``new(ref_path, cid, position)`` as log rows of one batch, in the order of ``position``."""
    return new.select(at(batch, F.col("position")).alias("seq"), ref_path(F.col("ref_path")).alias("ref_path"), "cid", F.lit("put").alias("op"))


def publish(manifests: DataFrame) -> DataFrame:
    """``seq, workflow, project, run_id, cid`` to the three refs of each run."""
    rows = F.array(
        F.struct(F.lit(0).alias("k"), workflow_ref(F.col("workflow")).alias("ref_path")),
        F.struct(F.lit(1).alias("k"), project_ref(F.col("project")).alias("ref_path")),
        F.struct(F.lit(2).alias("k"), run_ref(F.col("run_id")).alias("ref_path")),
    )
    out = manifests.select("seq", "cid", F.explode(rows).alias("r"))
    return out.select((F.col("seq") * 3 + F.col("r.k")).alias("seq"), "r.ref_path", "cid", F.lit("put").alias("op"))


def listed(log: DataFrame, prefix: str = "", raw: bool = False) -> DataFrame:
    """Current refs under a prefix of whole path parts; ``raw``: any string prefix."""
    p = F.col("ref_path")
    if raw:
        return current(log).filter(p.startswith(prefix))
    bare = prefix.rstrip("/")
    return current(log) if not bare else current(log).filter((p == bare) | p.startswith(f"{bare}/"))


def exists(log: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(current(log).select("ref_path"), "ref_path", "left_semi")


def delete(log: DataFrame, names: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """(tombstones to append at ``seq``, every name with whether it existed)."""
    now = current(log).select("ref_path", F.lit(True).alias("hit"))
    asked = names.select(ref_path(F.col("ref_path")).alias("ref_path")).distinct()
    found = asked.join(now, "ref_path", "left").select("ref_path", F.col("hit").isNotNull().alias("existed"))
    gone = found.filter("existed").select(
        seq.alias("seq"), "ref_path", F.lit(None).cast("string").alias("cid"), F.lit("delete").alias("op")
    )
    return gone, found


#: Parent links that are followed in one plan; longer walks are cut in the shared folder.
HOPS = 16


def history(starts: DataFrame, manifests: DataFrame, limit: int = 10) -> DataFrame:
    """``start, depth, cid``: parent links from each start, newest first, ``limit`` at most.

    ``starts(cid)``, ``manifests(cid, parent)``. Each start carries its walk, so
    every hop is one join of the starts that still go on with the links, whose
    shuffle all hops share. An unknown start has no history; a link to an
    unknown manifest ends it.
    """
    links = manifests.select(F.col("cid").alias("__at"), F.col("parent").alias("__next"))
    walk = starts.select(F.col("cid").alias("start")).join(links, F.col("start") == F.col("__at")).select(
        "start", F.array("start").alias("path"), F.col("__next").alias("next")
    )
    for hop in range(1, limit):
        step = walk.join(links, F.col("next") == F.col("__at"), "left")
        more = F.when(F.col("__at").isNotNull(), F.array("__at")).otherwise(F.array().cast(walk.schema["path"].dataType))
        walk = step.select("start", F.concat("path", more).alias("path"), F.col("__next").alias("next"))
        if hop % HOPS == 0:
            walk = checkpoint(walk)
    return walk.select("start", F.posexplode("path").alias("depth", "cid")).select("start", (F.col("depth") + 1).alias("depth"), "cid")
