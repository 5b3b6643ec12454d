"""Registered queries over the driver tables, each with the SQL that must agree with it.

Runs are ``orders`` (workflow: customer), outputs are ``lineitem`` rows (blob:
part), blob bodies are ``documents`` and ``pages``, ref updates are ``events``.
Names of objects are SHA-256 digests where only their identity matters; contents
are hashed with BLAKE3, which the SQL works out from the published algorithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import blake3, cbor, cid, metadata, paths
from cairn.operators import blobs, manifests, refs
from cairn.plans import sql
from cairn.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def _body() -> Column:
    """The text of a document; built when asked, as columns need a session."""
    return F.coalesce(F.col("text"), F.lit(""))


_DOCS_SQL = f"(SELECT doc_id, coalesce(text, '') AS text, {sql.cid_text('sha256(coalesce(text, chr(0)[1:0]))')} AS cid FROM documents)".replace("chr(0)[1:0]", "''")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", _body().alias("text"), cid.cid_of_digest(_digest(_body())).alias("cid"))


# Content identifiers


@query(f"SELECT doc_id, {sql.cid_text('h')} AS raw_cid, {sql.cid_text('h', '71')} AS object_cid FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)")
def cid_encode(spark, d):
    h = _digest(_body())
    return _t(spark, d, "documents").select(
        "doc_id", cid.cid_of_digest(h).alias("raw_cid"), cid.cid_of_digest(h, cid.DAG_CBOR).alias("object_cid")
    )


@query("SELECT doc_id, CAST(1 AS BIGINT) AS version, CAST(85 AS BIGINT) AS codec, CAST(30 AS BIGINT) AS hash_type, sha256(coalesce(text, '')) AS hash FROM documents")
def cid_decode(spark, d):
    return _docs(spark, d).select("doc_id", cid.cid_decode(F.col("cid")).alias("x")).select("doc_id", "x.*")


@query(
    f"""SELECT doc_id, form, regexp_matches(c, '^b[a-zA-Z2-7]+$') AS valid, regexp_matches(c, '^ba(fk|fy)r4i[a-z2-7]{{52}}$') AS canonical
    FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS form, unnest([cid, 'b' || upper(cid[2:]), cid[1:20], 'z' || cid[2:]]) AS c FROM {_DOCS_SQL})"""
)
def cid_valid(spark, d):
    c = F.col("cid")
    forms = F.array(c, F.concat(F.lit("b"), F.upper(F.substring(c, 2, 100))), F.left(c, F.lit(20)), F.concat(F.lit("z"), F.substring(c, 2, 100)))
    rows = _docs(spark, d).select("doc_id", F.posexplode(forms).alias("form", "c"))
    return rows.select("doc_id", "form", cid.cid_is_valid(F.col("c")).alias("valid"), cid.cid_is_canonical(F.col("c")).alias("canonical"))


_TEXTS = f"SELECT doc_id AS id, {sql.bytes_of("coalesce(text, '')")} AS hx FROM documents"


@query(
    f"""SELECT id AS doc_id, hash, sha256(unhex(outboard)) AS outboard_sha256, size, {sql.cid_text('hash')} AS cid
    FROM ({sql.blake3(_TEXTS, outboard=True)}) JOIN (SELECT doc_id AS id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents) USING (id)"""
)
def blake3_documents(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", blake3.hash_result(_body().cast("binary")).alias("h"))
    return docs.select("doc_id", "h.hash", F.sha2("h.outboard", 256).alias("outboard_sha256"), "h.size", cid.cid_of_digest(F.col("h.hash")).alias("cid"))


@query("SELECT doc_id, CAST(8 + 64 * (greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 1024.0)) - 1) AS BIGINT) AS outboard_bytes FROM documents")
def outboard_size(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", blake3.hash_result(_body().cast("binary")).alias("h"))
    return docs.select("doc_id", F.octet_length("h.outboard").cast("long").alias("outboard_bytes"))


@query(
    f"""SELECT doc_id, cid, codec, hash, f AS from_bytes FROM (
    SELECT doc_id, {sql.cid_text('h')} AS cid, CAST(85 AS BIGINT) AS codec, h AS hash, {sql.cid_text('h', '71')} AS f FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents))"""
)
def cid_decode_any(spark, d):
    """Identifiers read by the general header parser, and built from bytes."""
    docs = _docs(spark, d).select("doc_id", "cid", cid.cid_decode_any(F.concat(F.lit("b"), F.upper(F.substring("cid", 2, 100)))).alias("x"))
    return docs.select("doc_id", "cid", "x.codec", "x.hash", cid.cid_of_bytes(F.unhex("x.hash"), cid.DAG_CBOR).alias("from_bytes"))


_ENTRY_SQL = sql.mapping(
    {
        "@type": sql.text(f"'{manifests.OUTPUT_TYPE}'"), "file_name": sql.text("'doc' || doc_id"),
        "data_size_bytes": sql.integer("n_chars"), "lang": sql.text("lang"), "source": sql.text("source"),
    }
)


@query(
    f"""WITH o AS MATERIALIZED (SELECT doc_id AS id, {_ENTRY_SQL} AS hx, lang, source, n_chars FROM documents)
    SELECT id AS doc_id, {sql.cid_text('hash', '71')} AS cid, CAST(length(hx) // 2 AS BIGINT) AS n_bytes,
    '{{"lang":' || coalesce('"' || lang || '"', 'null') || ',"@type":"{manifests.OUTPUT_TYPE}","source":' || coalesce('"' || source || '"', 'null')
      || ',"file_name":"doc' || id || '","data_size_bytes":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || '}}' AS decoded
    FROM o JOIN ({sql.blake3('SELECT id, hx FROM o')}) USING (id)"""
)
def object_cid(spark, d):
    docs = _t(spark, d, "documents")
    entry = F.struct(F.lit(manifests.OUTPUT_TYPE).alias("@type"), F.concat(F.lit("doc"), F.col("doc_id")).alias("file_name"), F.col("n_chars").alias("data_size_bytes"), "lang", "source")
    coded = manifests.encode_objects(docs.select("doc_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("json")))
    return coded.select("doc_id", "cid", F.octet_length("bytes").cast("long").alias("n_bytes"), cbor.decode_json(F.col("bytes")).alias("decoded"))


# Blobs


@query(
    f"""SELECT cid, count(*) AS copies, CAST(max(octet_length(encode(text))) AS BIGINT) AS size,
    CAST((count(*) - 1) * max(octet_length(encode(text))) AS BIGINT) AS saved FROM {_DOCS_SQL} GROUP BY cid"""
)
def blob_dedupe_stats(spark, d):
    return blobs.dedupe_stats(_docs(spark, d).select("cid", F.octet_length("text").cast("long").alias("size")))


def _parts(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("cid"), "p_name", F.col("p_size").cast("long").alias("size"))


def _ordered(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"))


#: The blobs that a store holds: parts of which a whole lot went back; about a third of all.
_STORED = "l_returnflag = 'R' AND l_quantity >= 47"


def _stored(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").filter(_STORED).select(F.col("l_partkey").alias("cid"))


@query(f"SELECT p_partkey AS cid, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE {_STORED})")
def blob_exists(spark, d):
    return blobs.exists(_parts(spark, d).select("cid", "p_name"), _stored(spark, d))


@query(f"SELECT p_partkey AS cid, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {_STORED})")
def blob_missing(spark, d):
    return blobs.missing(_parts(spark, d).select("cid", "p_name"), _stored(spark, d))


#: A store of customers in credit; events name customers in debt too.
_HELD = "c_acctbal > 0"


def _customers(spark, d) -> DataFrame:
    return _t(spark, d, "customer").filter(_HELD).select(F.col("c_custkey").alias("cid"), F.col("c_name").alias("content"), F.octet_length("c_name").cast("long").alias("size"))


@query(f"SELECT event_id, user_id AS cid, CAST(coalesce(octet_length(encode(c_name)), -1) AS BIGINT) AS size FROM events LEFT JOIN (SELECT * FROM customer WHERE {_HELD}) ON c_custkey = user_id")
def blob_size_lookup(spark, d):
    keys = _t(spark, d, "events").select("event_id", F.col("user_id").alias("cid"))
    return blobs.sizes(keys, _customers(spark, d)).select("event_id", "cid", F.col("size").cast("long").alias("size"))


@query(f"SELECT event_id, user_id AS cid, c_name AS content FROM events LEFT JOIN (SELECT * FROM customer WHERE {_HELD}) ON c_custkey = user_id")
def blob_lookup(spark, d):
    keys = _t(spark, d, "events").select("event_id", F.col("user_id").alias("cid"))
    return blobs.lookup(keys, _customers(spark, d)).select("event_id", "cid", "content")


@query(
    """WITH k AS (SELECT DISTINCT l_partkey AS cid FROM lineitem WHERE l_returnflag = 'R')
    SELECT p_partkey AS cid, p_partkey NOT IN (SELECT cid FROM k) AS kept, p_partkey IN (SELECT cid FROM k) AS existed FROM part"""
)
def blob_delete(spark, d):
    keys = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("cid"))
    left, found = blobs.delete(_parts(spark, d), keys)
    kept = left.select("cid", F.lit(True).alias("kept"), F.lit(False).alias("existed"))
    return kept.unionByName(found.filter("existed").select("cid", F.lit(False).alias("kept"), "existed"))


@query(
    f"""WITH c AS (SELECT cid, lang, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM {_DOCS_SQL} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))
    SELECT DISTINCT cid, size FROM c WHERE cid NOT IN (SELECT cid FROM c WHERE lang = 'en')"""
)
def blob_upsert(spark, d):
    """Every document into a store that holds the English ones: one row per content that is new."""
    every = _t(spark, d, "documents").select("lang", _body().alias("text")).select(
        "lang", cid.cid_of_digest(_digest(F.col("text"))).alias("cid"), F.octet_length("text").cast("long").alias("size")
    )
    return blobs.upsert(every.filter("lang = 'en'").select("cid"), every.select("cid", "size"))


@query(
    """SELECT cid, min(name ORDER BY place) FILTER (WHERE place = best) AS name, CAST(min(place) AS INTEGER) AS location FROM (
    SELECT *, min(place) OVER (PARTITION BY cid) AS best FROM (
      SELECT CAST(s_nationkey AS BIGINT) AS cid, min(s_name) AS name, 0 AS place FROM supplier WHERE s_nationkey < 9 GROUP BY 1 UNION ALL
      SELECT CAST(c_nationkey AS BIGINT), min(c_name), 1 FROM customer WHERE c_nationkey BETWEEN 5 AND 17 GROUP BY 1 UNION ALL
      SELECT CAST(n_nationkey AS BIGINT), min(n_name), 2 FROM nation GROUP BY 1)) GROUP BY cid"""
)
def read_locations_fallback(spark, d):
    """Three stores that overlap: each holds keys that the ones before it lack."""

    def place(table, key, name, held="true"):
        return _t(spark, d, table).filter(held).groupBy(F.col(key).cast("long").alias("cid")).agg(F.min(name).alias("name"))

    found = blobs.from_locations([
        place("supplier", "s_nationkey", "s_name", "s_nationkey < 9"), place("customer", "c_nationkey", "c_name", "c_nationkey BETWEEN 5 AND 17"),
        place("nation", "n_nationkey", "n_name"),
    ])
    return found.select("cid", "name", F.col("location").cast("int").alias("location"))


# Metadata

_ENDINGS = ("BAM", "sam", "fastq.gz", "fq.gz", "fastq", "fq", "vcf.gz", "vcf", "bed", "csv", "tsv", "json", "html", "pdf", "csv.gz", "txt")
_NAME_SQL = "'doc' || doc_id || '.' || [" + ", ".join(f"'{e}'" for e in _ENDINGS) + "][1 + doc_id % 16]"


_TYPE_SQL = f"CASE {' '.join(f'WHEN ends_with(lower(name), {e!r}) THEN {t!r}' for e, t in metadata.FILE_TYPES)} ELSE '{metadata.OTHER_TYPE}' END"


@query(
    f"SELECT doc_id, name, {_TYPE_SQL} AS file_type "
    f"FROM (SELECT doc_id, {_NAME_SQL} AS name FROM documents)"
)
def file_type_guess(spark, d):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 16 + 1).cast("int"))
    named = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id"), F.lit("."), ending).alias("name"))
    return named.withColumn("file_type", metadata.file_type(F.col("name")))


@query("SELECT event_id, 'run-' || strftime(ts, '%Y-%m-%d-%H%M%S') || '-' || left(sha256(CAST(event_id AS VARCHAR)), 8) AS run_id FROM events")
def run_id(spark, d):
    return _t(spark, d, "events").select("event_id", metadata.run_id(F.col("ts"), _digest(F.col("event_id"))).alias("run_id"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN c_acctbal > 5000 THEN c_mktsegment
    WHEN c_acctbal > 0 THEN 'nation ' || c_nationkey ELSE 'script ' || c_custkey END AS project_id FROM customer"""
)
def project_id(spark, d):
    c = _t(spark, d, "customer")
    settings = F.map_filter(
        F.create_map(
            F.lit("blocks.project"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")),
            F.lit("project"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")),
            F.lit("manifest.name"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("nation "), F.col("c_nationkey"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    script = F.concat(F.lit("script "), F.col("c_custkey"))
    return c.select("c_custkey", metadata.project_id(settings, script).alias("project_id"))


@query(
    """SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END, ''), c_mktsegment, 'unknown') AS name,
    CASE WHEN c_nationkey < 5 THEN 'unknown' ELSE CAST(c_nationkey AS VARCHAR) END AS version, c_mktsegment AS repository,
    CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS revision, CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment END AS container_engine, 'run ' || c_custkey AS command_line,
    CAST(4 + (c_nationkey % 2 = 0)::INT + (c_nationkey % 3 > 0)::INT AS BIGINT) AS n_keys FROM customer"""
)
def workflow_meta(spark, d):
    none = F.lit(None).cast("string")
    script = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    version = F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey").cast("string"))
    commit = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name"))
    engine = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_mktsegment")).otherwise("")
    command = F.concat(F.lit("run "), F.col("c_custkey"))
    m = metadata.workflow_metadata(script, F.col("c_mktsegment"), version, F.lit(""), F.col("c_mktsegment"), none, commit, engine, command)
    keys = ("name", "version", "repository", "revision", "container_engine", "command_line")
    rows = _t(spark, d, "customer").select("c_custkey", m.alias("m"))
    return rows.select("c_custkey", *(F.col("m")[k].alias(k) for k in keys), F.size("m").cast("long").alias("n_keys"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failed' END AS status, '0' AS exit_code,
    CAST(nullif(CAST(floor(o_totalprice) AS BIGINT) // 1000, 0) AS VARCHAR) AS duration_seconds, 'false' AS resume,
    CASE WHEN o_custkey % 2 = 0 THEN 'unknown' ELSE o_orderpriority END AS nextflow_version, 'c' || o_custkey AS user_name,
    CASE WHEN o_orderstatus <> 'F' THEN 'status ' || o_orderstatus END AS error_message, 'run-' || o_orderkey AS run_name,
    CAST(8 + (CAST(floor(o_totalprice) AS BIGINT) >= 1000)::INT + (o_orderstatus <> 'F')::INT AS BIGINT) AS n_keys FROM orders"""
)
def exec_meta(spark, d):
    none = F.lit(None).cast("int")
    more = {
        "nextflow_version": F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")),
        "user_name": F.concat(F.lit("c"), F.col("o_custkey")), "run_name": F.concat(F.lit("run-"), F.col("o_orderkey")),
        "error_message": F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("status "), F.col("o_orderstatus"))),
    }
    m = metadata.execution_metadata(F.col("o_orderstatus") == "F", none, F.col("o_orderdate"), F.col("o_orderdate"), F.floor("o_totalprice"), **more)
    keys = ("status", "exit_code", "duration_seconds", "resume", *more)
    rows = _t(spark, d, "orders").select("o_orderkey", m.alias("m"))
    return rows.select("o_orderkey", *(F.col("m")[k].alias(k) for k in keys), F.size("m").cast("long").alias("n_keys"))


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 4 THEN NULL WHEN l_linenumber > 2 THEN 'task ' || l_partkey ELSE 'line ' || l_linenumber END, 'unknown') AS process_name,
    CAST(greatest(1, l_linenumber - 1) AS VARCHAR) AS attempt, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey % 3 AS VARCHAR) END AS cpus,
    nullif(l_returnflag, 'N') AS container, l_linestatus AS queue, CAST(3 + (l_linenumber <= 4)::INT + (l_suppkey % 3 > 0)::INT + (l_returnflag <> 'N')::INT AS BIGINT) AS n_keys FROM lineitem"""
)
def process_meta(spark, d):
    line = F.col("l_linenumber")
    task = {
        "process_name": F.when(line <= 2, F.concat(F.lit("line "), line)).otherwise(""),
        "task_name": F.when(line <= 4, F.concat(F.lit("task "), F.col("l_partkey"))), "attempt": line - 1, "cpus": F.col("l_suppkey") % 3,
        "container": F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), "queue": F.col("l_linestatus"),
    }
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", metadata.process_metadata(task).alias("m"))
    keys = ("process_name", "attempt", "cpus", "container", "queue")
    return rows.select("l_orderkey", "l_linenumber", *(F.col("m")[k].alias(k) for k in keys), F.size("m").cast("long").alias("n_keys"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events")
def normalize_meta(spark, d):
    m = metadata.normalize_map(F.from_json("props", "map<string,string>"))
    return _t(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("n_keys"))


@query("""SELECT event_id, '{"a":[1,{}],"p":{"k":' || json_extract_string(props, '$.k') || '}}' AS normal FROM events""")
def normalize_nested(spark, d):
    return _t(spark, d, "events").select("event_id", cbor.normalise_json(F.concat(F.lit('{"a":[1,null,{"b":null}],"p":'), F.col("props"), F.lit("}"))).alias("normal"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang END AS picked FROM documents")
def sample_meta_pick(spark, d):
    none = F.lit(None).cast("map<string,string>")

    def one(name, kind, entries, first):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), entries.alias("entries"), first.alias("first_entries"))

    lang = F.when(F.col("lang") != "en", F.create_map(F.lit("v"), F.col("lang")))
    inputs = F.array(one("reads", "list", none, lang), one("meta", "map", F.create_map(F.lit("v"), F.col("source")), none))
    return _t(spark, d, "documents").select("doc_id", metadata.sample_metadata(inputs)["v"].alias("picked"))


@query("SELECT n_nationkey, 'Hello, ' || n_name || '!' AS greeting FROM nation")
def greet(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", metadata.greeting(F.col("n_name")).alias("greeting"))


# Refs

_LOG_SQL = """(SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, 'workflows/' || event_type || '/u' || (user_id % 100) AS ref_path,
    CASE WHEN event_type = 'error' THEN NULL ELSE sha256(CAST(event_id AS VARCHAR)) END AS cid,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_id FROM events)"""


def _log(spark, d) -> DataFrame:
    """The update log; its order is (time, id) and stays a struct, so nothing is numbered in one task."""
    error = F.col("event_type") == "error"
    return _t(spark, d, "events").select(
        F.struct("ts", "event_id").alias("seq"), F.concat(F.lit("workflows/"), "event_type", F.lit("/u"), (F.col("user_id") % 100).cast("string")).alias("ref_path"),
        F.when(~error, _digest(F.col("event_id"))).alias("cid"), F.when(error, "delete").otherwise("put").alias("op"), "event_id",
    )


_CURRENT_SQL = f"(SELECT ref_path, arg_max(coalesce(cid, ''), seq) AS cid, arg_max(op, seq) AS op FROM {_LOG_SQL} GROUP BY ref_path)"


@query(f"SELECT ref_path, cid FROM {_CURRENT_SQL} WHERE op = 'put'")
def ref_current(spark, d):
    return refs.current(_log(spark, d))


@query(f"SELECT event_id, ref_path, lag(cid) OVER (PARTITION BY ref_path ORDER BY seq) AS previous FROM {_LOG_SQL}")
def ref_previous(spark, d):
    return refs.with_previous(_log(spark, d)).select("event_id", "ref_path", "previous")


@query(f"SELECT ref_path, cid FROM {_CURRENT_SQL} WHERE op = 'put' AND (ref_path = 'workflows/click' OR starts_with(ref_path, 'workflows/click/'))")
def ref_list_prefix(spark, d):
    return refs.listed(_log(spark, d), "workflows/click/")


#: Names to ask for: those of views and errors, and as many that never were.
_ASKED_SQL = """(SELECT DISTINCT kind || event_type || '/u' || (user_id % 100) AS n FROM events, (VALUES ('workflows/'), ('samples/')) k(kind) WHERE event_type IN ('view', 'error'))"""


def _asked(spark, d) -> DataFrame:
    some = _t(spark, d, "events").filter("event_type IN ('view', 'error')")
    kinds = F.explode(F.array(F.lit("/workflows/"), F.lit("samples/")))
    return some.select("event_type", "user_id", kinds.alias("kind")).select(
        F.concat("kind", "event_type", F.lit("/u"), (F.col("user_id") % 100).cast("string")).alias("ref_path")
    )


@query(
    f"""WITH c AS (SELECT ref_path FROM {_CURRENT_SQL} WHERE op = 'put'), a AS (SELECT n FROM {_ASKED_SQL})
    SELECT n AS ref_path, n IN (SELECT ref_path FROM c) AS existed, FALSE AS left_over, (SELECT count(*) FROM c WHERE ref_path NOT IN (SELECT n FROM a)) AS others FROM a"""
)
def ref_delete(spark, d):
    """Whether each name existed, whether it does after the tombstones, and how many other names are left."""
    log = _log(spark, d).select("seq", "ref_path", "cid", "op")
    gone, found = refs.delete(log, _asked(spark, d), F.struct(F.lit("9999-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id")))
    after = refs.current(log.unionByName(gone.select(F.col("seq").cast(log.schema["seq"].dataType).alias("seq"), "ref_path", "cid", "op")))
    rest = after.join(found, "ref_path", "left_anti").agg(F.count("*").alias("others"))
    kept = found.join(after.select("ref_path", F.lit(True).alias("hit")), "ref_path", "left")
    return kept.select("ref_path", "existed", F.col("hit").isNotNull().alias("left_over")).join(F.broadcast(rest))


@query(f"SELECT n AS ref_path FROM {_ASKED_SQL} WHERE n IN (SELECT ref_path FROM {_CURRENT_SQL} WHERE op = 'put')")
def ref_exists(spark, d):
    names = _asked(spark, d).select(refs.ref_path(F.col("ref_path")).alias("ref_path")).distinct()
    return refs.exists(_log(spark, d), names)


@query(
    """SELECT coalesce(n.ref_path, c.ref_path) AS ref_path, coalesce(n.cid, c.cid) AS cid FROM
    (SELECT 'samples/c' || o_custkey || '/latest' AS ref_path, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS cid FROM orders GROUP BY o_custkey) c
    FULL JOIN (SELECT 'samples/c' || c_custkey || '/latest' AS ref_path, 'new ' || c_name AS cid FROM customer WHERE c_nationkey < 5) n USING (ref_path)"""
)
def ref_update(spark, d):
    """A batch of renewed and new names over a log of an earlier batch; the latest write counts."""
    old = _t(spark, d, "orders").select(
        refs.sample_ref(F.concat(F.lit("c"), F.col("o_custkey"))).alias("ref_path"), _digest(F.col("o_orderkey")).alias("cid"), F.col("o_orderkey").alias("position")
    )
    new = _t(spark, d, "customer").filter("c_nationkey < 5").select(
        refs.sample_ref(F.concat(F.lit("c"), F.col("c_custkey"))).alias("ref_path"), F.concat(F.lit("new "), "c_name").alias("cid"), F.col("c_custkey").alias("position")
    )
    return refs.current(refs.update(old, F.lit(1)).unionByName(refs.update(new, F.lit(2))))


@query(
    """SELECT o_orderkey * 3 + k AS seq, ref_path, cid FROM (
    SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS cid, unnest([0, 1, 2]) AS k,
    unnest(['workflows/c' || o_custkey || '/latest', 'projects/' || o_orderpriority || '/latest', 'runs/run-' || o_orderkey]) AS ref_path FROM orders)"""
)
def ref_publish(spark, d):
    rows = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey")).alias("workflow"), F.col("o_orderpriority").alias("project"),
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), _digest(F.col("o_orderkey")).alias("cid"),
    )
    return refs.publish(rows).select("seq", "ref_path", "cid")


_RUNS_SQL = "(SELECT o_orderkey AS cid, o_custkey, lag(o_orderkey) OVER w AS parent, lead(o_orderkey) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _runs(spark, d) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("workflow"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return manifests.with_parent(o)


@query(
    f"""WITH RECURSIVE m AS (SELECT * FROM {_RUNS_SQL}), walk AS (
      SELECT cid AS start, 1 AS depth, cid, parent FROM m WHERE later IS NULL
      UNION ALL SELECT w.start, w.depth + 1, m.cid, m.parent FROM walk w JOIN m ON m.cid = w.parent WHERE w.depth < 10)
    SELECT start, CAST(depth AS INTEGER) AS depth, cid FROM walk"""
)
def ref_history(spark, d):
    runs = _runs(spark, d)
    last = runs.groupBy("workflow").agg(F.max_by("cid", "seq").alias("cid")).select("cid")
    return refs.history(last, runs)


# Manifests and links


@query(
    """SELECT l_orderkey AS run_id, CAST(l_linenumber AS VARCHAR) AS path, max(sha256(CAST(l_partkey AS VARCHAR))) AS cid
    FROM (SELECT *, max((l_shipdate, l_partkey)) OVER (PARTITION BY l_orderkey, l_linenumber) = (l_shipdate, l_partkey) AS last FROM lineitem) WHERE last
    GROUP BY 1, 2"""
)
def manifest_outputs(spark, d):
    rows = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("path"), _digest(F.col("l_partkey")).alias("cid"),
        F.struct("l_shipdate", "l_partkey").alias("seq"),
    )
    made = manifests.outputs_of(rows).select("run_id", F.explode("outputs").alias("path", "link"))
    return made.select("run_id", "path", manifests.link_target(F.col("link")).alias("cid"))


@query("SELECT cid AS run, o_custkey AS workflow, parent FROM " + _RUNS_SQL)
def manifest_parent(spark, d):
    return _runs(spark, d).select(F.col("cid").alias("run"), "workflow", "parent")


_MANIFEST_SQL = sql.mapping(
    {
        "@type": sql.text(f"'{manifests.RUN_TYPE}'"), "run_id": sql.text("CAST(run AS VARCHAR)"), "timestamp": sql.text("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"),
        "project": sql.text("o_orderpriority"), "user": sql.text("'c' || o_custkey"),
        "workflow": sql.mapping({"name": sql.text("'c' || o_custkey"), "version": sql.text("'unknown'"), "repository": "'f6'", "revision": "'f6'"}),
    },
    {
        "outputs": "outputs", "parent": f"CASE WHEN before IS NOT NULL THEN {sql.link('before')} END",
        "execution": sql.mapping(
            {k: "'f6'" for k in manifests.EXECUTION_CORE}
            | {"status": sql.text("'success'"), "exit_code": sql.integer("0"), "duration_seconds": sql.integer("CAST(floor(o_totalprice) AS BIGINT)")},
            {"peak_running_tasks": f"CASE WHEN o_custkey % 2 = 0 THEN {sql.integer('o_custkey % 100')} END"},
        ),
    },
)
_OUTPUTS_SQL = f"""SELECT run, {sql.head(5, 'count(*)')} || string_agg({sql.text('path')} || {sql.link('cid')}, '' ORDER BY length(path), path) AS outputs FROM (
    WITH c AS MATERIALIZED (SELECT run, path, {sql.cid_text('h')} AS cid FROM (
      SELECT l_orderkey AS run, 'out/' || l_linenumber AS path, sha256(CAST(arg_max(l_partkey, (l_shipdate, l_partkey)) AS VARCHAR)) AS h FROM lineitem GROUP BY ALL)) SELECT * FROM c) GROUP BY run"""


@query(
    f"""WITH r AS MATERIALIZED (SELECT cid, {sql.cid_text('p', '71')} AS before FROM (SELECT cid, sha256(CAST(parent AS VARCHAR)) AS p FROM {{runs}})),
    m AS MATERIALIZED (SELECT run, {_MANIFEST_SQL} AS hx FROM (SELECT o.*, r.before, o_orderkey AS run FROM orders o JOIN r ON r.cid = o_orderkey) LEFT JOIN ({_OUTPUTS_SQL}) USING (run))
    SELECT run AS run_id, {sql.cid_text('hash', '71')} AS cid, CAST(length(hx) // 2 AS BIGINT) AS n_bytes FROM m JOIN ({sql.blake3('SELECT run AS id, hx FROM m')}) ON id = run""".replace("{runs}", _RUNS_SQL)
)
def manifest_cid(spark, d):
    """Whole run manifests: outputs, parent, execution, canonical bytes and identifier."""
    lines = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("out/"), F.col("l_linenumber")).alias("path"), cid.cid_of_digest(_digest(F.col("l_partkey"))).alias("cid"),
        F.struct("l_shipdate", "l_partkey").alias("seq"),
    )
    o = _t(spark, d, "orders")
    runs = _runs(spark, d).select(F.col("cid").alias("run_id"), cid.cid_of_digest(_digest(F.col("parent")), cid.DAG_CBOR).alias("parent"))
    named = o.select(
        F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("o_orderpriority").alias("project"), F.concat(F.lit("c"), F.col("o_custkey")).alias("user"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("name"), F.lit("unknown").alias("version")).alias("workflow"),
        F.struct(
            F.lit("success").alias("status"), F.lit(0).alias("exit_code"), F.floor("o_totalprice").alias("duration_seconds"),
            F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 100).alias("peak_running_tasks"),
        ).alias("execution"),
    )
    whole = named.join(runs, "run_id").join(manifests.outputs_of(lines), "run_id", "left")
    whole = whole.withColumn("run_id", F.col("run_id").cast("string"))
    coded = manifests.encode_objects(manifests.run_json(whole)).withColumn("run_id", F.col("run_id").cast("long"))
    return coded.select("run_id", "cid", F.octet_length("bytes").cast("long").alias("n_bytes"))


@query(
    """SELECT 'workflows/c' || o_custkey || '/latest' AS ref_path, o_orderkey AS cid, l_linenumber AS path, l_partkey AS blob, CAST(p_size AS BIGINT) AS size
    FROM (SELECT o_custkey, max((o_orderdate, o_orderkey)).o_orderkey AS o_orderkey FROM (SELECT o_custkey, struct_pack(o_orderdate := o_orderdate, o_orderkey := o_orderkey) AS s, o_orderdate, o_orderkey FROM orders) GROUP BY 1) r
    LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey""".replace("max((o_orderdate, o_orderkey)).o_orderkey", "max(s).o_orderkey")
)
def lineage_dereference(spark, d):
    runs = _runs(spark, d)
    last = runs.groupBy("workflow").agg(F.max_by("cid", "seq").alias("cid"))
    names = last.select(refs.workflow_ref(F.concat(F.lit("c"), F.col("workflow"))).alias("ref_path"), "cid")
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("blob"))
    held = _parts(spark, d).select(F.col("cid").alias("blob"), "size")
    found = manifests.dereference(names, runs.select("cid", F.col("cid").alias("run_id")), lines, held)
    return found.select("ref_path", "cid", "path", "blob", "size")


_PAGE_SQL = sql.bytes_of("coalesce(html, '')")
_NAME_OF_URL = "regexp_extract(url, '[^/]*$')"


@query(
    f"""WITH p AS MATERIALIZED (SELECT page_id, {_NAME_OF_URL} AS name, {_PAGE_SQL} AS hx FROM pages),
    b AS MATERIALIZED (SELECT page_id, name, length(hx) // 2 AS size, {sql.cid_text('hash')} AS data_cid FROM p JOIN ({sql.blake3('SELECT page_id AS id, hx FROM p')}) ON id = page_id),
    o AS MATERIALIZED (SELECT *, {sql.mapping(
        {
            "@type": sql.text(f"'{manifests.OUTPUT_TYPE}'"), "file_name": sql.text("name"), "file_type": sql.text(_TYPE_SQL), "data_blob": sql.link("data_cid"),
            "data_size_bytes": sql.integer("size"), "data_hash_algorithm": sql.text(f"'{manifests.DIGEST}'"), "produced_at": sql.text("'2024-01-01T00:00:00Z'"),
        },
        {
            "sample_metadata": f"CASE WHEN page_id % 2 = 0 THEN {sql.mapping({'page': sql.text('CAST(page_id AS VARCHAR)')})} END",
            "process_metadata": sql.mapping({"attempt": sql.text("'1'"), "process_name": sql.text("'crawl'")}),
        },
    )} AS hx FROM b)
    SELECT page_id, name AS file_name, data_cid, CAST(size AS BIGINT) AS size, {sql.cid_text('hash', '71')} AS metadata_cid, CAST(length(hx) // 2 AS BIGINT) AS n_bytes
    FROM o JOIN ({sql.blake3('SELECT page_id AS id, hx FROM o')}) ON id = page_id"""
)
def ingest_pages(spark, d):
    """Pages as files: blobs, sizes, and output metadata with sample and process entries."""
    files = _t(spark, d, "pages").select(F.col("url").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), "page_id")
    sample = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("page"), F.col("page_id").cast("string"), F.lit("none"), F.lit(None).cast("string")))
    process = metadata.process_metadata({"process_name": F.lit("crawl")})
    found = ingest.ingest(files, F.lit("2024-01-01T00:00:00Z"), sample, process, keep=("page_id",))
    return found.select("page_id", "file_name", "data_cid", "size", "metadata_cid", F.octet_length("metadata").cast("long").alias("n_bytes"))


_REACHED = "l_returnflag = 'R' AND l_quantity >= 47"


@query(f"SELECT p_partkey AS blob FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {_REACHED})")
def unreachable_blobs(spark, d):
    reached = _t(spark, d, "lineitem").filter(_REACHED).select(F.col("l_partkey").alias("blob"))
    return manifests.unreachable(_t(spark, d, "part").select(F.col("p_partkey").alias("blob")), reached)


@query(f"SELECT event_id AS src_cid, 'user' AS edge, user_id AS dst_cid FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE {_HELD})")
def dangling_links(spark, d):
    links = _t(spark, d, "events").select(F.col("event_id").alias("src_cid"), F.lit("user").alias("edge"), F.col("user_id").alias("dst_cid"))
    return manifests.dangling(links, _customers(spark, d)).select("src_cid", "edge", "dst_cid")


# Paths and URIs



def _url_path() -> Column:
    return F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^[a-z]+://", "/")


_PATHS_SQL = "(SELECT page_id, regexp_replace(coalesce(url, ''), '^[a-z]+://', '/') AS p FROM pages)"


def _paths(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", _url_path().alias("p"))


@query(f"SELECT page_id, CASE WHEN NOT contains(p, '/') THEN NULL WHEN regexp_extract(p, '(?s)^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(p, '(?s)^(.*)/[^/]*$', 1) END AS parent FROM {_PATHS_SQL}")
def path_parent(spark, d):
    return _paths(spark, d).select("page_id", paths.parent(F.col("p")).alias("parent"))


@query(f"SELECT page_id, CASE WHEN p IN ('', '/') THEN NULL ELSE regexp_extract(p, '(?s)([^/]*)$', 1) END AS file_name, starts_with(p, '/') AS absolute FROM {_PATHS_SQL}")
def path_filename(spark, d):
    return _paths(spark, d).select("page_id", paths.file_name(F.col("p")).alias("file_name"), paths.is_absolute(F.col("p")).alias("absolute"))


@query(f"SELECT page_id, '/' || array_to_string(list_filter(string_split(p, '/')[1:-1], lambda x: x NOT IN ('', '.')), '/') AS normal FROM (SELECT page_id, p || '/./x/..' AS q, p || '/' AS p FROM {_PATHS_SQL})")
def path_normalize(spark, d):
    return _paths(spark, d).select("page_id", paths.normalize(F.concat(F.col("p"), F.lit("/./x/.."))).alias("normal"))


@query(
    f"""SELECT page_id, 'root/' || p || '/x' AS built, CASE WHEN starts_with(p, '/') THEN '/' END AS root, starts_with(p, '/blog') AS blog,
    starts_with(p, '/blog/') OR p = '/blog' AS blog_parts, ends_with(p, 'feed') AS feed, i AS position, string_split({{inner}}, '/')[1 + i] AS part
    FROM (SELECT *, unnest(range(len(string_split({{inner}}, '/')))) AS i FROM {_PATHS_SQL})""".replace("{inner}", "regexp_replace(regexp_replace(p, '^/', ''), '/+$', '')")
)
def path_parts(spark, d):
    p = F.col("p")
    return _paths(spark, d).select(
        "page_id", paths.path_of(F.lit("root"), p, F.lit("x")).alias("built"), paths.root(p).alias("root"), paths.starts_with(p, F.lit("/blog")).alias("blog"),
        paths.starts_with(p, F.lit("/blog"), parts=True).alias("blog_parts"), paths.ends_with(p, F.lit("feed")).alias("feed"),
        F.posexplode(paths.names(p)).alias("position", "part"),
    ).withColumn("position", F.col("position").cast("long"))


_INNER = "regexp_replace(regexp_replace(p, '^/', ''), '/+$', '')"


@query(f"SELECT page_id, CAST(len(string_split({_INNER}, '/')) AS INTEGER) AS n, string_split({_INNER}, '/')[1] AS head, array_to_string(string_split({_INNER}, '/')[1:2], '/') AS sub FROM {_PATHS_SQL}")
def path_subpath(spark, d):
    p = F.col("p")
    return _paths(spark, d).select("page_id", paths.name_count(p).alias("n"), paths.name(p, 0).alias("head"), paths.subpath(p, 0, 2).alias("sub"))


@query(
    f"""SELECT page_id, p || '/a.txt' AS child, regexp_extract(p, '(?s)^(.*)/[^/]*$', 1) || '/b' AS sibling,
    'blocks+file://' || p AS uri, regexp_replace(p, '^/', '') AS rest FROM {_PATHS_SQL}"""
)
def path_resolve(spark, d):
    p = F.col("p")
    return _paths(spark, d).select(
        "page_id", paths.resolve(p, F.lit("a.txt")).alias("child"), paths.resolve_sibling(p, F.lit("b")).alias("sibling"),
        paths.to_uri(p).alias("uri"), paths.relativize(F.lit("/"), p).alias("rest"),
    )


@query(
    """SELECT page_id, ported, regexp_extract(url, '^([a-z]+)', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, CASE WHEN ported THEN '8020' ELSE '-1' END AS port,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN ported THEN ':8020' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS underlying
    FROM (SELECT page_id, url, unnest([false, true]) AS ported FROM pages)"""
)
def uri_parse(spark, d):
    """Each page's URL as a store, and once more with a user and a port."""
    both = _t(spark, d, "pages").select("page_id", "url", F.explode(F.array(F.lit(False), F.lit(True))).alias("ported"))
    full = F.regexp_replace("url", "^([a-z]+://)([^/?#]*)", "$1me:pw@$2:8020")
    u = F.concat(F.lit("blocks+"), F.when(F.col("ported"), full).otherwise(F.col("url")))
    rows = both.select("page_id", "ported", paths.parse_store_uri(u).alias("x"), paths.underlying_uri(u).alias("underlying"))
    return rows.select("page_id", "ported", "x.scheme", "x.host", "x.port", "x.path", "underlying")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
