"""Run, process and sample metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings, the first that fits counts.
FILE_TYPES = (
    (".bam", "application/x-bam"),
    (".sam", "application/x-sam"),
    (".fastq.gz", "application/gzip"),
    (".fq.gz", "application/gzip"),
    (".fastq", "text/plain"),
    (".fq", "text/plain"),
    (".vcf.gz", "application/gzip"),
    (".vcf", "text/plain"),
    (".bed", "text/plain"),
    (".csv", "text/csv"),
    (".tsv", "text/tab-separated-values"),
    (".json", "application/json"),
    (".html", "text/html"),
    (".pdf", "application/pdf"),
)
OTHER_TYPE = "application/octet-stream"
PROCESS_KEYS = (
    "process_name", "task_name", "container", "cpus", "memory", "time", "disk", "queue", "executor", "module",
    "conda", "exit_status", "attempt", "scratch",
)


def file_type(name: Column) -> Column:
    lower, out = F.lower(name), F
    for ending, kind in FILE_TYPES:
        out = out.when(lower.endswith(ending), kind)
    return out.otherwise(OTHER_TYPE)


def _given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def without_nulls(entries: dict[str, Column]) -> Column:
    made = F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def workflow_metadata(
    script: Column, project: Column, version: Column, repository: Column, home: Column, revision: Column, commit: Column,
    container_engine: Column | None = None, command_line: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return without_nulls(
        {
            "name": _given(script, project, F.lit("unknown")),
            "version": _given(version, F.lit("unknown")),
            "repository": _given(repository, home),
            "revision": _given(revision, commit),
            "container_engine": _given(none if container_engine is None else container_engine),
            "command_line": _given(none if command_line is None else command_line),
        }
    )


def execution_metadata(success: Column, exit_code: Column, started: Column, completed: Column, millis: Column, **more: Column) -> Column:
    """Status, exit code (0 if unknown), whole seconds (none for zero), resume (false if unknown) and engine version (``unknown``)."""
    return without_nulls(
        {
            "nextflow_version": _given(more.pop("nextflow_version", F.lit(None).cast("string")), F.lit("unknown")),
            "started_at": started,
            "completed_at": completed,
            "duration_seconds": F.nullif((millis / 1000).cast("long"), F.lit(0).cast("long")),
            "status": F.when(success, "success").otherwise("failed"),
            "exit_code": F.coalesce(exit_code, F.lit(0)),
            "resume": F.coalesce(more.pop("resume", F.lit(None).cast("boolean")), F.lit(False)),
            **more,
        }
    )


def process_metadata(task: dict[str, Column] | None) -> Column:
    """The known keys of a task that hold something; no task gives an empty map.

    The process is named after the task if need be, and ``attempt`` counts from 1.
    """
    if task is None:
        return F.create_map().cast("map<string,string>")
    known = {k: task.get(k, F.lit(None)).cast("string") for k in PROCESS_KEYS}
    known["process_name"] = _given(known["process_name"], known["task_name"], F.lit("unknown"))
    known["container"] = _given(known["container"])
    known["cpus"] = F.nullif(_given(known["cpus"]), F.lit("0"))
    known["attempt"] = F.coalesce(F.nullif(known["attempt"], F.lit("0")), F.lit("1"))
    return without_nulls(known)


def sample_metadata(inputs: Column) -> Column:
    """Of ``array<struct<name, kind, entries, first_entries>>`` the first input that fits.

    An input named ``meta`` that is a map fits even if empty; any map that is not
    empty does; so does a list whose first item is a map.
    """
    fits = lambda x: (
        ((x["name"] == "meta") & (x["kind"] == "map"))
        | ((x["kind"] == "map") & (F.size(x["entries"]) > 0))
        | ((x["kind"] == "list") & x["first_entries"].isNotNull())
    )
    first = F.get(F.filter(inputs, fits), 0)
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(first["kind"] == "map", first["entries"]).otherwise(first["first_entries"]), none)


def normalize_map(entries: Column) -> Column:
    """A flat map without null values; keys are text already."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def project_id(settings: Column, script: Column) -> Column:
    """The first key that is present among the project settings, then the script, then ``default``."""
    has = lambda k: F.map_contains_key(settings, k)
    return (
        F.when(has("blocks.project"), settings["blocks.project"])
        .when(has("project"), settings["project"])
        .when(has("manifest.name"), settings["manifest.name"])
        .otherwise(_given(script, F.lit("default")))
    )


def run_id(started: Column, session: Column) -> Column:
    """``run-{time}-{first eight of the session id}``."""
    time = F.coalesce(F.date_format(started, "yyyy-MM-dd-HHmmss"), F.lit("unknown"))
    return F.concat(F.lit("run-"), time, F.lit("-"), F.coalesce(F.left(session, F.lit(8)), F.lit("unknown")))


def greeting(target: Column) -> Column:
    return F.concat(F.lit("Hello, "), target, F.lit("!"))
