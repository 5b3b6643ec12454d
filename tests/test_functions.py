import base64
import struct

import pytest
from pyspark.sql import functions as F

from cairn.functions import blake3, cbor, cid, metadata, paths

EMPTY = "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
RAW_CID = "bafkr4ifpcne3t5pzugtkaqcn5i3nzskjtpfslsnnyejlpte2spfoihzsmi"
OBJECT_CID = "bafyr4ifpcne3t5pzugtkaqcn5i3nzskjtpfslsnnyejlpte2spfoihzsmi"
LENGTHS = (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 8191, 8192, 8193)


def scalar(data: bytes) -> bytes:
    """BLAKE3 word by word, recursively."""
    mask, iv = 0xFFFFFFFF, blake3.IV

    def compress(cv, block, counter, size, flags):
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*cv, *iv[:4], counter & mask, counter >> 32, size, flags]

        def g(a, b, c, d, x, y):
            rot = lambda z, n: (z >> n | z << (32 - n)) & mask
            for word, p, q in ((x, 16, 12), (y, 8, 7)):
                v[a] = (v[a] + v[b] + word) & mask
                v[d] = rot(v[d] ^ v[a], p)
                v[c] = (v[c] + v[d]) & mask
                v[b] = rot(v[b] ^ v[c], q)

        for _ in range(7):
            for k in range(4):
                g(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
            for k in range(4):
                g(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
            m = [m[p] for p in blake3.PERMUTATION]
        return [v[k] ^ v[k + 8] for k in range(8)]

    def node(part, first, root):
        if len(part) <= 1024:
            cv, blocks = list(iv), [part[k : k + 64] for k in range(0, len(part), 64)] or [b""]
            for k, b in enumerate(blocks):
                end = k == len(blocks) - 1
                cv = compress(cv, b, first, len(b), (k == 0) | end << 1 | (end and root) << 3)
            return cv
        half = 1024
        while half * 2 < len(part):
            half *= 2
        both = node(part[:half], first, False) + node(part[half:], first + half // 1024, False)
        return compress(list(iv), struct.pack("<16I", *both), 0, 64, 4 | root << 3)

    return struct.pack("<8I", *node(data, 0, True))


def test_blake3_equals_the_scalar_form():
    texts = [bytes(i * 7 % 251 for i in range(n)) for n in LENGTHS]
    found = blake3.hash_all(texts, outboards=True)
    assert found[0][0].hex() == EMPTY
    for text, (digest, board) in zip(texts, found):
        assert digest == scalar(text)
        assert len(board) == 8 + 64 * (max(1, -(-len(text) // 1024)) - 1) and board[:8] == len(text).to_bytes(8, "little")
    assert blake3.hash_all([]) == [] and blake3.digest(texts[5]) == found[5][0]


def test_cids(spark):
    df = spark.createDataFrame([(EMPTY,), ("zz" * 32,), (EMPTY[:-2],), (None,), (EMPTY.upper(),)], "h string")
    h = F.col("h")
    rows = df.select(cid.cid_of_digest(h).alias("raw"), cid.cid_of_digest(h, cid.DAG_CBOR).alias("obj")).collect()
    assert [(r["raw"], r["obj"]) for r in rows[:4]] == [(RAW_CID, OBJECT_CID), (None, None), (None, None), (None, None)]
    assert rows[4]["raw"] == RAW_CID
    by_hand = "b" + base64.b32encode(bytes([1, 0x55, 0x1E, 32]) + bytes.fromhex(EMPTY)).decode().lower().rstrip("=")
    assert by_hand == RAW_CID
    forms = spark.createDataFrame([(RAW_CID,), ("invalid",), ("",), (None,), ("b",), ("z" + RAW_CID[1:],), ("b" + RAW_CID[1:].upper(),)], "c string")
    c = F.col("c")
    rows = forms.select(cid.cid_is_valid(c).alias("v"), cid.cid_is_canonical(c).alias("k"), cid.cid_decode(c).alias("d")).collect()
    assert [(r["v"], r["k"]) for r in rows] == [(True, True), *[(False, False)] * 5, (True, False)]
    assert tuple(rows[0]["d"]) == (1, 0x55, 0x1E, EMPTY) and tuple(rows[6]["d"]) == (1, 0x55, 0x1E, EMPTY)


def test_decode_reads_any_header(spark):
    wide = cid.encode(b"\1" * 20, codec=0x1234, hash_type=0x300)
    assert cid.decode(wide) == {"version": 1, "codec": 0x1234, "hash_type": 0x300, "hash": "01" * 20}
    assert cid.decode(cid.encode(bytes.fromhex(EMPTY))) == {"version": 1, "codec": 0x55, "hash_type": 0x1E, "hash": EMPTY}
    assert cid.encode(bytes.fromhex(EMPTY)) == RAW_CID and cid.decode(RAW_CID[:40])["hash"].endswith("00")
    for bad in ("", "b", "zabc", "b0189", "bae"):
        with pytest.raises(ValueError):
            cid.decode(bad)
    df = spark.createDataFrame([(wide,), ("zabc",), (None,)], "c string")
    assert [r[0] and r[0]["codec"] for r in df.select(cid.cid_decode_any(F.col("c"))).collect()] == [0x1234, None, None]
    raw = df.limit(1).select(cid.cid_of_bytes(F.unhex(F.lit(EMPTY)))).first()[0]
    assert raw == RAW_CID


def test_varints():
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert cid.read_varint(cid.varint(n) + b"x") == (n, len(cid.varint(n)))
    with pytest.raises(EOFError):
        cid.read_varint(b"\x80")


@pytest.mark.parametrize(
    ("value", "data"),
    [
        (None, "f6"), (True, "f5"), (False, "f4"), (0, "00"), (23, "17"), (24, "1818"), (256, "190100"), (-1, "20"), (-500, "3901f3"),
        (1 << 40, "1b0000010000000000"), ("é", "62c3a9"), (b"\1\2", "420102"), ([1, [2]], "82018102"),
        ({"bb": 1, "a": 2, "c": 3}, "a361610261630362626201"), ({"/": "x"}, "a1612f6178"), (1.5, "63312e35"), (1e10, "66312e30453130"),
    ],
)
def test_cbor(value, data):
    assert cbor.encode(value).hex() == data
    if not isinstance(value, float):
        assert cbor.decode(bytes.fromhex(data)) == value


def test_float_text_is_javas():
    got = [cbor.float_text(x) for x in (1e-5, 0.001, 123456.0, 1e7, 12345678.9, float("nan"), -1e300, 0.0)]
    assert got == ["1.0E-5", "0.001", "123456.0", "1.0E7", "1.23456789E7", "NaN", "-1.0E300", "0.0"]


def test_objects_do_not_depend_on_key_order():
    a, b = {"x": 1, "y": {"k": [1, 2], "j": None}}, {"y": {"j": None, "k": [1, 2]}, "x": 1}
    assert cbor.encode(a) == cbor.encode(b)
    assert cbor.normalise({"a": None, 1: [None, {"b": None}], "c": {}}) == {"1": [{}], "c": {}}


def test_paths(spark):
    def of(column, *values):
        df = spark.createDataFrame([(v,) for v in values], "p string")
        return [r[0] for r in df.select(column(F.col("p"))).collect()]

    assert of(paths.file_name, "", "/", "/a", "a", "a/b/", "/a/b") == [None, None, "a", "a", "", "b"]
    assert of(paths.parent, "", "/", "/a", "a", "a/b", "a/b/") == [None, "/", "/", None, "a", "a/b"]
    assert of(paths.name_count, "/", "", "/a//b/", "a", "/a//", "//", "///", "//a") == [0, 0, 3, 1, 1, 0, 0, 2]
    assert of(lambda p: paths.name(p, 0), "/a/b", "c") == ["a", "c"]
    assert of(lambda p: paths.subpath(p, 1, 3), "/a/b/c") == ["b/c"]
    for bad in (lambda p: paths.name(p, 2), lambda p: paths.subpath(p, 1, 3), lambda p: paths.relativize(F.lit("/x"), p)):
        with pytest.raises(Exception, match="range|base"):
            of(bad, "/a/b")
    assert of(paths.normalize, "/a/./b/../c", "../a", "/../a//b", "a/..") == ["/a/c", "a", "/a/b", ""]
    assert of(lambda p: paths.resolve(p, F.lit("x")), "/", "", "/a", "a/") == ["/x", "x", "/a/x", "a//x"]
    assert of(lambda p: paths.resolve(p, F.lit("")), "/a", "") == ["/a/", ""]
    assert of(lambda p: paths.resolve(p, F.lit("x"), keep_root=False), "/") == ["x"]
    assert of(lambda p: paths.starts_with(p, F.lit("/a")), "/ab", "/a/b") == [True, True]
    assert of(lambda p: paths.starts_with(p, F.lit("/a"), parts=True), "/ab", "/a/b", "/a") == [False, True, True]
    assert of(lambda p: paths.relativize(F.lit("/a"), p, strict=False), "/a/b", "/c", "a") == ["b", None, None]
    uris = of(paths.parse_store_uri, "blocks:/x", "blocks+file:///x", "blocks+s3://b:9000/p?q", "file:///x")
    assert [u and tuple(u) for u in uris] == [("file", None, "-1", "/x"), ("file", None, "-1", "/x"), ("s3", "b", "9000", "/p"), None]
    assert of(paths.underlying_uri, "blocks+s3://b:9000/p?q#f", "blocks+file:///x") == ["s3://b:9000/p", "file:///x"]


def test_metadata_fallbacks(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        metadata.process_metadata(None).alias("no"), metadata.process_metadata({}).alias("bare"),
        metadata.process_metadata({"task_name": F.lit("t"), "cpus": F.lit(0), "attempt": F.lit(3)}).alias("task"),
        metadata.workflow_metadata(F.lit(""), none, none, none, none, none, none, F.lit("docker"), F.lit("")).alias("flow"),
        metadata.execution_metadata(F.lit(False), F.lit(2), none, none, F.lit(999)).alias("run"),
    ).first()
    assert row["no"] == {} and row["bare"] == {"process_name": "unknown", "attempt": "1"}
    assert row["task"] == {"process_name": "t", "task_name": "t", "attempt": "3"}
    assert row["flow"] == {"name": "unknown", "version": "unknown", "container_engine": "docker"}
    assert row["run"] == {"nextflow_version": "unknown", "status": "failed", "exit_code": "2", "resume": "false"}


def test_file_types(spark):
    names = ["A.BAM", "x.fq.gz", "x.vcf.gz", "x.csv.gz", "x.txt", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = ["application/x-bam", "application/gzip", "application/gzip", *["application/octet-stream"] * 3]
    assert [r[0] for r in df.select(metadata.file_type(F.col("n"))).collect()] == want
