"""Output metadata and run manifests: assembly, maps, and the links between objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import blake3
from cairn.functions.cid import DAG_CBOR, cid_of_digest

#: Object types and the digest's name in stored objects.
OUTPUT_TYPE, RUN_TYPE, DIGEST = "NextflowOutputFile", "NextflowRun", "blake3"

LINK = T.StructType([T.StructField("/", T.StringType())])
OUTPUT_CORE = ("@type", "file_name", "file_type", "data_blob", "data_size_bytes", "data_hash_algorithm", "produced_at")
OUTPUT_MORE = ("sample_metadata", "process_metadata", "produced_by_run")
RUN_CORE = ("@type", "run_id", "timestamp", "project", "user", "workflow")
RUN_MORE = ("parameters", "outputs", "parent", "execution")
WORKFLOW_CORE, WORKFLOW_MORE = ("name", "version", "repository", "revision"), ("definition",)
EXECUTION_CORE = (
    "started_at", "completed_at", "duration_seconds", "status", "exit_code", "executor", "compute_environment", "nextflow_version",
)
EXECUTION_MORE = (
    "total_cpu_hours", "total_memory_gb_hours", "peak_running_tasks", "resumed_from", "cached_processes", "recomputed_processes",
)
EXECUTION_NUMBERS = ("total_cpu_hours", "total_memory_gb_hours")


def link(cid: Column) -> Column:
    return F.when(cid.isNotNull(), F.struct(cid.alias("/")))


def link_target(column: Column) -> Column:
    """The cid of a link; an error if the link has none."""
    target = column["/"]
    empty = column.isNotNull() & (F.coalesce(target, F.lit("")) == "")
    return F.when(empty, F.raise_error(F.lit("link without a target")).cast("string")).otherwise(target)


def to_map(fields: dict, core: tuple[str, ...], more: tuple[str, ...]) -> dict:
    """Core keys always, optional keys only where they hold something (numbers: not null)."""
    held = lambda v: v is not None and (isinstance(v, (int, float)) or bool(v))
    return {k: fields.get(k) for k in core} | {k: fields[k] for k in more if held(fields.get(k))}


def output_map(fields: dict) -> dict:
    return to_map({"@type": OUTPUT_TYPE, "data_hash_algorithm": DIGEST, **fields}, OUTPUT_CORE, OUTPUT_MORE)


def workflow_map(fields: dict) -> dict:
    return to_map(fields, WORKFLOW_CORE, WORKFLOW_MORE)


def execution_map(fields: dict) -> dict:
    return to_map(fields, EXECUTION_CORE, EXECUTION_MORE)


def run_map(fields: dict) -> dict:
    whole = {"@type": RUN_TYPE, **fields}
    if whole.get("workflow") is not None:
        whole["workflow"] = workflow_map(whole["workflow"])
    if whole.get("execution"):
        whole["execution"] = execution_map(whole["execution"])
    return to_map(whole, RUN_CORE, RUN_MORE)


def _known(value: dict | None, *keys: str) -> dict:
    return {k: v for k, v in (value or {}).items() if k in keys}


def output_from(value: dict) -> dict:
    return {"@type": OUTPUT_TYPE, "data_hash_algorithm": DIGEST} | _known(value, *OUTPUT_CORE, *OUTPUT_MORE)


def run_from(value: dict) -> dict:
    out = {"@type": RUN_TYPE} | _known(value, *RUN_CORE, *RUN_MORE)
    if out.get("workflow"):
        out["workflow"] = _known(out["workflow"], *WORKFLOW_CORE, *WORKFLOW_MORE)
    if out.get("execution"):
        execution = _known(out["execution"], *EXECUTION_CORE, *EXECUTION_MORE)
        out["execution"] = {k: float(v) if k in EXECUTION_NUMBERS else v for k, v in execution.items()}
    return out


def outputs_of(outputs: DataFrame) -> DataFrame:
    """``run_id, outputs``: path to link, the last registration of a path wins.

    ``outputs(run_id, path, cid, seq)``.
    """
    last = outputs.groupBy("run_id", "path").agg(F.max_by("cid", "seq").alias("cid"))
    entry = F.struct("path", link(F.col("cid")).alias("link"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("outputs"))


def with_parent(runs: DataFrame) -> DataFrame:
    """Runs with the cid of the same workflow's run before, by ``seq``."""
    return runs.withColumn("parent", F.lag("cid").over(Window.partitionBy("workflow").orderBy("seq")))


def encode_objects(objects: DataFrame, column: str = "json") -> DataFrame:
    """``objects`` with their canonical bytes and cid."""
    coded = objects.withColumn("__coded", blake3.coded_objects(F.col(column)))
    return coded.withColumns({"bytes": F.col("__coded.bytes"), "cid": cid_of_digest(F.col("__coded.hash"), DAG_CBOR)}).drop("__coded")


def _member(name: str, value: Column) -> Column:
    """``"name":value``, null values written out."""
    text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _held(value: Column, kind: T.DataType) -> Column:
    """Whether an optional value is written: numbers if not null, all else if not empty."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) > 0
    return value != "" if isinstance(kind, T.StringType) else value.isNotNull()


def object_json(fields: dict[str, tuple[Column, T.DataType]], core: tuple[str, ...], more: tuple[str, ...], fixed: dict[str, str] | None = None, nested: dict[str, Column] | None = None) -> Column:
    """The JSON of an object from columns: core keys always, optional keys where they hold something.

    ``fixed``: keys with a value of their own; ``nested``: JSON texts, null where absent.
    """
    fixed, nested, parts = fixed or {}, nested or {}, []
    for key in (*core, *more):
        if key in nested:
            text = F.concat(F.lit(f'"{key}":'), nested[key])
            parts.append(text if key in more else F.coalesce(text, F.lit(f'"{key}":null')))
        elif key in fixed:
            parts.append(_member(key, F.lit(fixed[key])))
        elif key in fields:
            value, kind = fields[key]
            parts.append(_member(key, value) if key in core else F.when(_held(value, kind), _member(key, value)))
        elif key in core:
            parts.append(F.lit(f'"{key}":null'))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _fields(df: DataFrame, within: str | None = None) -> dict[str, tuple[Column, T.DataType]]:
    """The columns of a frame, or the fields of one of its structs, with their types."""
    if within is None:
        return {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    return {f.name: (F.col(within)[f.name], f.dataType) for f in df.schema[within].dataType}


def run_json(runs: DataFrame) -> DataFrame:
    """``run_id, json`` of run manifests from columns.

    Columns and fields of the structs ``workflow`` and ``execution`` go by the
    objects' keys; any may be absent. ``parent`` and ``parameters`` are
    identifiers. Core keys are written even where they are null.
    """
    nested = {}
    for key, core, more in (("workflow", WORKFLOW_CORE, WORKFLOW_MORE), ("execution", EXECUTION_CORE, EXECUTION_MORE)):
        if key in runs.columns:
            nested[key] = F.when(F.col(key).isNotNull(), object_json(_fields(runs, key), core, more))
    fields = _fields(runs)
    for key in ("parent", "parameters"):
        if key in fields:
            fields[key] = link(F.col(key)), LINK
    return runs.select("run_id", object_json(fields, RUN_CORE, RUN_MORE, {"@type": RUN_TYPE}, nested).alias("json"))


def output_json(outputs: DataFrame) -> Column:
    """The JSON of output metadata; ``data_blob`` and ``produced_by_run`` are identifiers."""
    fields = _fields(outputs)
    for key in ("data_blob", "produced_by_run"):
        if key in fields:
            fields[key] = link(F.col(key)), LINK
    return object_json(fields, OUTPUT_CORE, OUTPUT_MORE, {"@type": OUTPUT_TYPE, "data_hash_algorithm": DIGEST})


def dereference(refs: DataFrame, manifests: DataFrame, outputs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Ref to manifest to outputs to blob, keeping what dangles.

    ``refs(ref_path, cid)``, ``manifests(cid, run_id)``, ``outputs(run_id, path, blob)``, ``blobs(blob, size)``.
    """
    runs = refs.join(manifests, "cid", "left")
    return runs.join(outputs, "run_id", "left").join(blobs, "blob", "left")


def unreachable(blobs: DataFrame, reached: DataFrame) -> DataFrame:
    return blobs.join(reached.select("blob"), "blob", "left_anti")


def dangling(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links whose target is not stored: ``links(src_cid, edge, dst_cid)``, ``objects(cid)``."""
    return links.join(objects.select(F.col("cid").alias("dst_cid")), "dst_cid", "left_anti")
