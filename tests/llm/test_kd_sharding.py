import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cairn.llm import kd_sharding as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ("doc_id", "shard", "size", "slot", "text_crc32")


def by_sql(docs, shards=16):
    """The k-d tree with medians from plain running sums."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    return con.sql(K.oracle(shards)).project(", ".join(COLUMNS)).fetchall()


def check(docs, shards=16):
    out = K.shard(docs, shards).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        want[r["doc_id"], len(data) + 1, zlib.crc32(data)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return out, sizes


def test_sizes_are_near_equal_and_as_in_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, sizes = check(docs)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=key) == sorted(by_sql(docs), key=key)


@pytest.mark.parametrize(("count", "same"), [(64, False), (64, True), (160, True)])
def test_texts_of_one_size_are_dealt_out_evenly(spark, count, same):
    rows = [(i, "just the same" if same else f"no. {i:09d}", "en", "src0", 1) for i in range(count)]
    _, sizes = check(spark.createDataFrame(rows, SCHEMA))
    assert len(sizes) == 16 and max(sizes.values()) == min(sizes.values())


def test_one_huge_document_and_copies_of_one_row(spark):
    rows = [(0, "x" * 100_000, "en", "src0", 1)] + [(7, "copy " * 20, "en", "src0", 1)] * 1500
    _, sizes = check(spark.createDataFrame(rows, SCHEMA), 4)
    rest = sorted(sizes.values())
    assert rest[-1] == 100_001 and rest[-2] < 1.05 * sum(rest) / 4


def test_shard_counts_that_are_no_power_of_two(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, sizes = check(docs, 5)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_odd_rows_and_hot_groups(odd, empty, spark):
    out, _ = check(odd)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=key) == sorted(by_sql(odd), key=key)
    assert K.shard(empty).count() == 0
    rows = [(i, "the same text" if i % 3 else f"text {i} " * 3, "en", "src0", 1) for i in range(3000)]
    _, sizes = check(spark.createDataFrame(rows, SCHEMA))
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_documents_of_one_source_come_together(spark):
    rows = [(i, f"{i:05d} " + "x" * (i * 37 % 400), ("de", "en")[i // 4 % 2], f"src{i % 4}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out, sizes = check(docs, 8)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    shards = defaultdict(Counter)
    for r in out:
        shards[r["doc_id"] % 4, r["doc_id"] // 4 % 2][r["shard"]] += 1
    # Source and language are cut before the length is, but for ties at the cuts.
    assert len(shards) == 8 and all(sum(n for _, n in c.most_common(2)) > 0.9 * sum(c.values()) for c in shards.values())


def test_no_python_in_the_plan(documents):
    assert "Python" not in K.shard(documents)._jdf.queryExecution().toString()
