import pytest
from pyspark.sql import functions as F

from cairn.operators import blobs, manifests, refs
from cairn.functions import blake3, cbor, cid
from cairn.sources import blocks, files, stores
from cairn.sources.config import Config, ConfigError, store_path
from cairn.sources.stores import blob_store, ref_store
from cairn.streaming import ingest
from cairn.streaming.flow import Flow

OK = {
    "enabled": True,
    "storage": {"uri": "blocks+file:///tmp/blocks"},
    "readLocations": ["blocks+file:///tmp/cache", "blocks+file:///tmp/blocks"],
    "refs": {"uri": "refs+file:///tmp/refs"},
}


def test_config():
    c = Config.parse(OK)
    c.validate()
    assert c.enabled and len(c.read_locations) == 2 and c.storage.uri == "blocks+file:///tmp/blocks"
    assert not Config.parse(None).enabled and not Config.parse({}).enabled
    assert Config.parse({"enabled": "false"}).enabled and Config.parse(OK | {"readLocations": "x"}).read_locations == []
    Config.parse({"enabled": False}).validate()
    for bad in ({"storage": None}, {"refs": {}}, {"storage": {"uri": "file:///x"}}):
        with pytest.raises(ConfigError):
            Config.parse(OK | bad).validate()
    assert store_path("blocks+s3://bucket/a/b/", "blocks") == "s3a://bucket/a/b"
    for uri in (None, "", "refs+file:///x", "blocks+ftp://x"):
        with pytest.raises(ConfigError):
            store_path(uri, "blocks")


def test_file_stores(tmp_path):
    store = blob_store(f"blocks+file://{tmp_path}")
    assert store.write_blob("test-hash-123", b"Hello, World!") and store.read_blob("test-hash-123") == b"Hello, World!"
    assert store.exists("test-hash-123") and store.size("test-hash-123") == 13 and store.size("none") == -1
    assert store.write_outboard("test-hash-456", b"Mock outboard") and store.read_outboard("test-hash-456") == b"Mock outboard"
    assert not store.exists("test-hash-456") and store.read_blob("none") is None
    assert store.delete("test-hash-123") and not store.exists("test-hash-123") and not store.delete("test-hash-123")
    names = ref_store(f"refs+file://{tmp_path}")
    for ref, cid in (("workflows/test1/latest", "cid1"), ("/workflows/test2/latest", "cid2"), ("projects/proj1/latest", "cid3")):
        assert names.write(ref, cid) and names.read(ref) == cid
    assert len(names.list()) == 3 and len(names.list("workflows/")) == 2 and names.list("work") == []
    assert names.delete("workflows/test1/latest") and not names.delete("workflows/test1/latest")
    assert not (tmp_path / "refs/workflows/test1").exists()
    with pytest.raises(ValueError):
        names.write("a/../../b", "x")


def test_tables_over_stores(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    for name, data in (("a.bam", b"A" * 3000), ("b.csv", b"x,y"), ("c.csv", b"x,y"), ("d.txt", b"z")):
        (files / name).write_bytes(data)
    uri = f"blocks+file://{tmp_path}/store"
    q = ingest.watch(spark, str(files), uri, str(tmp_path / "cp"), "2024-01-01T00:00:00Z")
    q.awaitTermination(120)
    held = blocks.read_blobs(spark, uri)
    assert held.filter("size = 3000").count() == 1 and held.count() == 3 + 4
    assert {r["cid"] for r in blocks.read_outboards(spark, uri).collect()} < {r["cid"] for r in held.collect()}
    source = spark.read.format("binaryFile").load(str(files)).select("path", "content")
    again = ingest.ingest(source, F.lit("2024-01-01T00:00:00Z"))
    assert ingest.pending(again, held).count() == 0
    ids = again.select(F.col("metadata_cid").alias("cid"))
    assert blobs.missing(ids, held).count() == 0
    ingest.publish(spark, spark.createDataFrame([("/runs/r1", "cid1"), ("runs2/x", "cid2")], "ref_path string, cid string"), f"refs+file://{tmp_path}/store")
    got = blocks.read_refs(spark, f"refs+file://{tmp_path}/store", "runs").collect()
    assert [(r["ref_path"], r["cid"]) for r in got] == [("runs/r1", "cid1")]
    assert blocks.read_locations(spark, [uri, uri]).filter("location = 0").count() == held.count()


def test_ref_log(spark):
    log = spark.createDataFrame([(1, "workflows/a/latest", "c1", "put"), (2, "workflows/a/latest", "c2", "put"), (3, "runs/1", "c2", "put")], "seq long, ref_path string, cid string, op string")
    new = spark.createDataFrame([(0, "/workflows/b/latest", "c3")], "position int, ref_path string, cid string")
    log = log.withColumn("seq", refs.at(F.lit(0), F.col("seq").cast("int")))
    log = log.unionByName(refs.update(new, F.lit(1)))
    assert {(r["ref_path"], r["cid"]) for r in refs.listed(log, "workflows").collect()} == {("workflows/a/latest", "c2"), ("workflows/b/latest", "c3")}
    assert refs.listed(log, "work").count() == 0 and refs.listed(log, "work", raw=True).count() == 2
    gone, found = refs.delete(log, spark.createDataFrame([("/runs/1",), ("none",), ("runs/1",)], "ref_path string"), refs.at(F.lit(2)))
    assert {(r["ref_path"], r["existed"]) for r in found.collect()} == {("runs/1", True), ("none", False)}
    after = log.unionByName(gone)
    assert refs.exists(after, found).count() == 0
    previous = {(*r["seq"], r["previous"]) for r in refs.with_previous(after).collect()}
    assert (0, 2, "c1") in previous and (2, 0, "c2") in previous


def test_manifest_maps():
    whole = manifests.run_map({"run_id": "r", "workflow": {"name": "w", "definition": None}, "outputs": {}, "parent": {"/": "p"}, "execution": {"status": "success", "total_cpu_hours": 0.0}})
    assert set(whole) == {*manifests.RUN_CORE, "parent", "execution"} and whole["user"] is None
    assert whole["execution"]["total_cpu_hours"] == 0.0 and "definition" not in whole["workflow"]
    back = manifests.run_from(whole | {"extra": 1, "execution": whole["execution"] | {"total_cpu_hours": "0.5"}})
    assert back["execution"]["total_cpu_hours"] == 0.5 and "extra" not in back
    assert manifests.output_from({})["data_hash_algorithm"] == "blake3"
    assert "sample_metadata" not in manifests.output_map({"sample_metadata": {}})


def test_history_follows_parents_up_to_the_limit(spark):
    runs = spark.range(1, 60).select(F.col("id").cast("string").alias("cid"), F.nullif((F.col("id") - 1).cast("string"), F.lit("0")).alias("parent"))
    runs = runs.unionByName(spark.createDataFrame([("x", "lost")], "cid string, parent string"))
    starts = spark.createDataFrame([("59",), ("3",), ("x",), ("none",)], "cid string")
    found = {}
    for r in refs.history(starts, runs, 40).collect():
        found.setdefault(r["start"], {})[r["depth"]] = r["cid"]
    assert found["3"] == {1: "3", 2: "2", 3: "1"} and found["x"] == {1: "x"} and "none" not in found
    assert found["59"] == {k: str(60 - k) for k in range(1, 41)}
    assert refs.history(starts, runs, 1).count() == 3


def test_run_json_is_the_object_map(spark):
    rows = spark.createDataFrame(
        [
            ("r1", "2024", None, "u", ("w", None), {"a": ("c1",)}, "p", ("success", 0, 1.5, [])),
            ("r2", None, "x", None, None, {}, None, None),
        ],
        "run_id string, timestamp string, project string, user string, workflow struct<name: string, version: string>, outputs map<string, struct<`/`: string>>, "
        "parent string, execution struct<status: string, exit_code: int, total_cpu_hours: double, cached_processes: array<string>>",
    )
    plain = [
        {"run_id": "r1", "timestamp": "2024", "user": "u", "workflow": {"name": "w"}, "outputs": {"a": {"/": "c1"}}, "parent": {"/": "p"}, "execution": {"status": "success", "exit_code": 0, "total_cpu_hours": 1.5, "cached_processes": []}},
        {"run_id": "r2", "project": "x"},
    ]
    coded = manifests.encode_objects(manifests.run_json(rows)).orderBy("run_id").collect()
    for row, fields in zip(coded, plain):
        want = cbor.encode(manifests.run_map(fields))
        assert bytes(row["bytes"]) == want and row["cid"] == cid.encode(blake3.digest(want), cid.DAG_CBOR)
    assert manifests.run_from(cbor.decode(bytes(coded[0]["bytes"])))["execution"]["total_cpu_hours"] == 1.5


def test_bucket_stores_write_in_place(tmp_path):
    """What a bucket's file system goes through, over a folder."""
    local = files.files.LocalFileSystem()
    at = stores.Place(files.files.SubTreeFileSystem(str(tmp_path), local), "bucket/pre", False)
    (tmp_path / "bucket/pre/blobs").mkdir(parents=True)
    (tmp_path / "bucket/pre/refs/runs").mkdir(parents=True)
    held, names = stores.Blobs(at), stores.Refs(at)
    (tmp_path / "big").write_bytes(b"x" * (9 << 20))
    assert held.write_blob("c", tmp_path / "big") and held.size("c") == 9 << 20 and held.write_outboard("c", b"o")
    assert held.delete("c") and not held.exists("c") and held.read_outboard("c") is None and not held.delete("c")
    assert names.write("runs/r", "cid\n") and names.read("runs/r") == "cid" and names.list("runs") == ["runs/r"]
    assert names.delete("runs/r") and not names.exists("runs/r") and (tmp_path / "bucket/pre/refs/runs").exists()
    bucket = stores.place("blocks+s3://bucket/pre/", "blocks", region="us-east-1")
    assert not bucket.renames and bucket.path("blobs", "c") == "bucket/pre/blobs/c"


def test_file_operations(tmp_path):
    base = f"blocks+file://{tmp_path}"
    files.create_directory(f"{base}/d/e")
    (tmp_path / "d/a").write_bytes(b"abc")
    files.copy(f"{base}/d/a", f"{base}/d/.b")
    files.move(f"{base}/d/a", f"{base}/d/e/a")
    assert files.attributes(f"{base}/d/e/a")["size"] == 3 and files.attributes(f"{base}/d/a")["kind"] == "absent"
    assert files.is_hidden(f"{base}/d/.b") and files.same_file(f"{base}/d/e", f"{base}/d/../d/e")
    with pytest.raises(OSError):
        files.delete(f"{base}/d/e")
    files.delete(f"{base}/d/e/a")
    files.delete(f"{base}/d/e")
    with pytest.raises(FileNotFoundError):
        files.check_access(f"{base}/d/e")
    with pytest.raises(ConfigError):
        files.copy("file:///x", f"{base}/y")


def test_paths_are_read_back_by_name(spark, tmp_path):
    uri = f"blocks+file://{tmp_path}/store"
    schema = "path string, content binary"
    blocks.write_paths(spark.createDataFrame([("a/x", bytearray(b"one")), ("a/y", bytearray(b"two"))], schema), uri, 1)
    blocks.write_paths(spark.createDataFrame([("a/x", bytearray(b"three"))], schema), uri, 2)
    asked = spark.createDataFrame([("a/x",), ("a/y",), ("none",)], "path string")
    got = {r["path"]: r for r in blocks.read_paths(spark, uri, asked).collect()}
    assert bytes(got["a/x"]["content"]) == b"three" and bytes(got["a/y"]["content"]) == b"two" and got["none"]["cid"] is None
    assert got["a/x"]["cid"] == cid.encode(blake3.digest(b"three"))
    folder = blocks.list_folder(spark, str(tmp_path / "store/blobs"), F.col("length") == 5)
    assert folder.count() == 1


def test_flow_from_configuration_to_refs(spark, tmp_path):
    settings = {"enabled": True, "storage": {"uri": f"blocks+file://{tmp_path}/s"}, "refs": {"uri": f"refs+file://{tmp_path}/s"}}
    parents = []
    for run in ("run-1", "run-2"):
        flow = Flow.create(spark, settings, run, "2024-01-01T00:00:00Z")
        rows = spark.createDataFrame([("/w/a.csv", bytearray(b"1")), ("/v/a.csv", bytearray(b"22"))], "path string, content binary")
        flow.add(rows.limit(1), "2024", sample=F.create_map(F.lit("id"), F.lit("s1")))
        flow.add(rows.filter("path = '/v/a.csv'"), "2024")
        made = flow.complete({"name": "w"}, {"status": "success", "exit_code": 0}, "p", "u")
        body = cbor.decode(flow.blobs.read_blob(made))
        assert cid.encode(blake3.digest(flow.blobs.read_blob(made)), cid.DAG_CBOR) == made
        assert [flow.names.read(r) for r in ("workflows/w/latest", "projects/p/latest", f"runs/{run}")] == [made] * 3
        assert set(body) == {*manifests.RUN_CORE, "outputs", "execution", *(["parent"] if parents else [])} and list(body["outputs"]) == ["a.csv"]
        output = cbor.decode(flow.blobs.read_blob(body["outputs"]["a.csv"]["/"]))
        assert output["data_size_bytes"] == 2 and flow.blobs.read_blob(output["data_blob"]["/"]) == b"22"
        assert body.get("parent", {}).get("/") == (parents[-1] if parents else None)
        parents.append(made)
    for bad in (None, {"enabled": True}, settings | {"storage": {"uri": "blocks+ftp://x"}}):
        flow = Flow.create(spark, bad, "r", "t")
        assert not flow.enabled and flow.complete({}, {}, "p", "u") is None


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.executorEnv.PYTHONPATH", "").getOrCreate())
import __spark_entry__ as e
for name in sys.argv[3:]:
    rows = e.queries()[name](spark, sys.argv[2]).count()
    print(name, rows, file=sys.stderr)
    assert rows
"""


def test_executors_need_no_copy_of_the_package(sf, tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "run.py").write_text(ELSEWHERE)
    names = ["blake3_documents", "object_cid", "normalize_nested", "cid_decode_any"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", str(Path(__file__).parents[1]), sf, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
