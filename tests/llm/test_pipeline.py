"""Every stage on its own input, written and read again, against SQL or brute force."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import pii, quality_rules, simhash
from tests.llm.test_suffix_dedup import brute


def by_sql(sql, docs, *columns):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(sql).project(", ".join(columns)).fetchall()


def rows(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def quality(before):
    kept = {d for d, k in by_sql(quality_rules.oracle(), before, "doc_id", "kept") if k}
    return Counter({k: n for k, n in rows(before).items() if k[0] in kept})


def near(before):
    first = {c for _, c in by_sql(simhash.oracle(), before, "doc_id", "component_id")}
    return Counter(k for k in rows(before) if k[0] in first)


def repeats(before):
    every = list(rows(before).elements())
    cut = brute([(r[1] or "").encode() for r in every], 200)
    return Counter((r[0], c[2].decode("utf-8", "ignore") if c[0] else r[1], *r[2:]) for r, c in zip(every, cut))


def private(before):
    spans = dict(by_sql(pii.oracle(), before, "doc_id", "spans"))
    out = Counter()
    for r, n in rows(before).items():
        text, at, done = r[1], 0, ""
        for s in filter(None, spans[r[0]].split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                done += text[at : int(a)] + pii.LABELS[kind]
            at = max(at, int(b))
        out[r[0], done + text[at:] if spans[r[0]] else text, *r[2:]] += n
    return out


def check_packing(before, packed):
    of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = defaultdict(dict), defaultdict(dict)
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces[r["doc_id"]][r["start"]] = ids
        places[r["sequence_id"]][r["offset"]] = r["length"]
    for r in before.collect():
        want = of.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert [x for k in sorted(pieces[r["doc_id"]]) for x in pieces[r["doc_id"]][k]] == want
    assert len(pieces) == before.count()
    for held in places.values():
        ends = [0] + [k + held[k] for k in sorted(held)]
        assert sorted(held) == ends[:-1] and ends[-1] <= 4096


@pytest.fixture(scope="module")
def inputs(spark, documents, odd):
    """The small table, odd rows with ids of their own, and texts that each stage acts on."""
    extra = [
        (20_000 + i, f"The {w} of the house is at the end of the road and he is not in it for the {w} day, call jo{i}@mail.org now", "en", "src1", 9)
        for i, w in enumerate(("first", "second", "third"))
    ]
    extra += [(30_000, None, None, None, None), (30_001, "", "en", "src0", 0)]
    own = odd.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null").dropDuplicates(["doc_id"])
    own = own.withColumn("doc_id", own["doc_id"] + 10_000)
    return documents.unionByName(own).unionByName(spark.createDataFrame(extra, documents.schema))


def test_stages_equal_sql_and_brute_force(spark, sf, inputs, tmp_path):
    wanted = {"quality_rules": quality, "simhash": near, "suffix_dedup": repeats, "pii": private}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*wanted, "packing"]
    docs, sizes = inputs, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name == "packing":
            check_packing(docs, after)
        else:
            assert after.columns == inputs.columns and after.dtypes == inputs.dtypes
            assert rows(after) == wanted[name](docs), name
            sizes.append((after.count(), after.agg({"n_chars": "count"}).first()[0]))
        docs = after
    assert sizes[0][0] < inputs.count() and sizes[1][0] < sizes[0][0]


def test_extra_columns_and_empty_tables(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() <= odd.count()
        assert stage(spark, empty, sf).count() == 0
    assert corpus_pipeline.pack(spark, empty, sf).count() == 0
    assert corpus_pipeline.pack(spark, odd, sf).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
