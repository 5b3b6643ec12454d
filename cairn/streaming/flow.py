"""The life of one run: set up from its configuration, outputs as they come, a manifest and its refs at the end."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import manifests
from cairn.sources.config import Config
from cairn.sources.stores import Blobs, Refs, blob_store, ref_store
from cairn.streaming import ingest

log = logging.getLogger(__name__)


@dataclass
class Flow:
    """``create``, any number of ``add``, then ``complete``. A flow that is not enabled does nothing."""

    spark: SparkSession
    enabled: bool = False
    config: Config = field(default_factory=Config)
    run_id: str = ""
    started: str = ""
    blobs: Blobs | None = None
    names: Refs | None = None
    outputs: list[DataFrame] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, settings: dict | None, run_id: str, started: str) -> Flow:
        """A bad configuration is logged and leaves the flow disabled; it never fails the run."""
        flow = cls(spark, config=Config.parse(settings), run_id=run_id, started=started)
        if flow.config.enabled:
            try:
                flow.config.validate()
                flow.blobs, flow.names = blob_store(flow.config.storage.uri), ref_store(flow.config.refs.uri)
                flow.enabled = True
            except (ValueError, OSError) as e:
                log.error("run %s is not recorded: %s", run_id, e)
        return flow

    def add(self, files: DataFrame, produced_at: str, **columns: Any) -> None:
        """Store files and keep them as outputs; a later file of the same name takes its place."""
        if self.enabled:
            found = ingest.ingest(files, F.lit(produced_at), **columns)
            ingest.store(self.spark, found, self.config.storage.uri)
            rows = found.select(F.lit(self.run_id).alias("run_id"), F.col("file_name").alias("path"), F.col("metadata_cid").alias("cid"))
            self.outputs.append(rows.withColumn("seq", F.struct(F.lit(len(self.outputs)).alias("batch"), "cid")))

    def complete(self, workflow: dict[str, str], execution: dict[str, Any], project: str, user: str) -> str | None:
        """Write the manifest, then the refs that name it; its cid, or None if that failed, which is logged."""
        if not self.enabled:
            return None
        try:
            return self._publish(workflow, execution, project, user)
        except Exception as e:
            log.error("run %s was not published: %s", self.run_id, e)
            return None

    def _publish(self, workflow: dict[str, str], execution: dict[str, Any], project: str, user: str) -> str:
        name = workflow.get("name") or "unknown"
        latest = f"workflows/{name}/latest"
        # The parent is what the name holds now, so no placeholder is ever written.
        parent = self.names.read(latest)
        kinds = {"duration_seconds": "long", "exit_code": "int"}

        def entries(values: dict[str, Any], core: tuple[str, ...]):
            return F.struct(*(F.lit(values.get(k)).cast(kinds.get(k, "string")).alias(k) for k in core))

        run = self.spark.range(1).select(
            F.lit(self.run_id).alias("run_id"), F.lit(self.started).alias("timestamp"), F.lit(project).alias("project"), F.lit(user).alias("user"),
            F.lit(parent).cast("string").alias("parent"),
            entries(workflow | {"name": name}, manifests.WORKFLOW_CORE).alias("workflow"), entries(execution, manifests.EXECUTION_CORE).alias("execution"),
        )
        if self.outputs:
            rows = self.outputs[0]
            for more in self.outputs[1:]:
                rows = rows.unionByName(more)
            run = run.join(manifests.outputs_of(rows), "run_id", "left")
        found = manifests.encode_objects(manifests.run_json(run)).select("bytes", "cid").first()
        self.blobs.write_blob(found["cid"], found["bytes"])
        for ref in (latest, f"projects/{project}/latest", f"runs/{self.run_id}"):
            self.names.write(ref, found["cid"])
        log.info("run %s is %s", self.run_id, found["cid"])
        return found["cid"]


