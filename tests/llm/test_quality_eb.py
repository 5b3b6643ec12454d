import math
from collections import defaultdict

from pyspark.sql import functions as F

from cairn.llm import quality_eb as Q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    out = Q.classify(docs, train)
    assert out.count() == docs.count()
    rows = out.join(held, "doc_id").collect()
    right = sum((r["quality_probability"] >= 0.5) == (r["quality"] == 1) for r in rows) / len(rows)
    toxic = [r["is_toxic"] for r in rows if r["toxic"] == 1]
    clean = [r["is_toxic"] for r in rows if r["toxic"] == 0]
    print(right, sum(toxic) / len(toxic), sum(clean) / len(clean))
    assert right > 0.95 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.02


def test_sparse_sites_shrink(spark):
    rows = [(i, "good calm words here " * 3 + str(i), "en", "big.example/a") for i in range(200)]
    rows += [(1000 + i, "junk spam win cash " * 3 + str(i), "en", "bad.example/b") for i in range(200)]
    rows += [(2000, "junk spam win cash", "en", "new.example/c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows[:-1]], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    assert out[0]["kept"] and not out[1000]["kept"]
    assert out[1000]["quality_path"] < out[2000]["quality_path"] < out[0]["quality_path"]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None, None), (4, 1, 0), (4, 0, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.classify(odd, labels)
    assert out.count() == odd.count() and out.filter("kept").count() == odd.count()
    assert Q.classify(empty, labels).count() == 0
    assert Q.classify(odd, labels.limit(0)).count() == odd.count()


def test_posteriors_equal_sums_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.withColumn("source", F.concat("source", F.when(F.col("doc_id") % 3 == 0, "/a").when(F.col("doc_id") % 3 == 1, "/b/c").otherwise("")))
    rows = Q.classify(docs, labels).collect()
    assert {r["path"] for r in rows} >= {"a", "b", "en"} and not any("/" in r["host"] for r in rows)
    clip = lambda p: min(1 - 1e-6, max(1e-6, p))
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))
    for t in Q.TARGETS:
        hosts, paths = defaultdict(list), defaultdict(list)
        for r in rows:
            hosts[r["host"]].append(r[f"{t}_evidence"])
            paths[r["host"], r["path"]].append(r[f"{t}_evidence"])
        mean = sum(r[f"{t}_evidence"] for r in rows) / len(rows)

        def strength(sites, mean=mean):
            some = [(sum(p) / len(p), sum(x * x for x in p) / len(p), len(p)) for p in sites.values() if len(p) > 1]
            between = sum((m - mean) ** 2 for m, _, _ in some) / len(some)
            noise = sum((s - m * m) / n for m, s, n in some) / len(some)
            return min(1e4, max(1.0, mean * (1 - mean) / max(1e-6, between - noise) - 1))

        a, b = strength(hosts), strength(paths)
        host = {h: (a * mean + sum(p)) / (a + len(p)) for h, p in hosts.items()}
        path = {k: (b * host[k[0]] + sum(p)) / (b + len(p)) for k, p in paths.items()}
        for r in rows:
            place = r["host"], r["path"]
            z = logit(r[f"{t}_evidence"]) + logit(path[place]) - logit(mean)
            assert abs(r[f"{t}_host"] - host[place[0]]) < 1e-9 and abs(r[f"{t}_path"] - path[place]) < 1e-9
            if 1e-5 < r[f"{t}_evidence"] < 1 - 1e-5:
                assert abs(r[f"{t}_probability"] - 1 / (1 + math.exp(-z))) < 1e-6


def test_repeated_rows_do_not_reach_the_driver(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i % 7}", "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    taken = []
    fit, Q.fit = Q.fit, lambda rows, places, values, y: taken.append(len(y)) or fit(rows, places, values, y)
    try:
        Q.train(docs, labels, most=2)
    finally:
        Q.fit = fit
    assert taken and max(taken) <= 2
