import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from cairn.llm import ann


def brute(rows, every=100, k=10):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in rows if j != i)
            out[i] = near[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({j for _, j in got.get(q, [])} & {j for _, j in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got, want = found(ann.search(vectors)), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, j): s for q, near in want.items() for s, j in near}
    assert all(abs(exact[q, j] - s) < 1e-12 for q, near in got.items() for s, j in near if (q, j) in exact)


def test_leaves_are_split_in_spark(spark):
    """A top tree from a small sample, trees within its leaves, against brute force."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(ann.search(df, split=100, sample=160)), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9


def test_few_leaves_are_visited():
    vectors = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist())
    tree = ann.fit(vectors, int(ann.LEAVES * len(vectors) ** 0.5))
    own = ann.file_under(tree, vectors)
    ranks, queries = [], vectors[::20]
    for q in queries:
        place = {leaf: n for n, leaf in enumerate(ann.best_bins(tree, q, len(tree["rows"])))}
        near = np.argsort(((vectors - q) ** 2).sum(1), kind="stable")[1:11]
        ranks += [place[own[j]] for j in near]
    assert np.quantile(ranks, 0.92) < 0.45 * len(tree["rows"])


def test_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    rows += [(1000 + i, [float(i), 1.0, -float(i)]) for i in range(50)]
    odd = [(100, None), (200, [0.0, 0.0, 0.0]), (2000, [1.0, nan, 1.0]), (2100, [inf, 1.0, 1.0]), (2200, [None, 1.0, 1.0]), (2300, [1.0])]
    good = [r for r in rows if r[0] not in (100, 200)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got, want = found(ann.search(df)), brute(good)
    assert got.keys() == want.keys() == {0, 1000}
    assert got[0] == want[0] and got[0][:3] == [(0.0, 1), (0.0, 2), (0.0, 3)]
    assert got[1000] == want[1000]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, score double"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1.0), (1, [0.0, 1.0], 1.0), (2, [1.0, 1.0], 1.0)], schema)
    assert [j for _, j in found(ann.search(few))[0]] == [2, 1]
    assert ann.search(spark.createDataFrame([], schema)).count() == 0


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in sys.argv[3:]:
    assert e.queries()[name](spark, sys.argv[2]).count(), name
"""


def test_executors_need_no_copy_of_the_package(sf, tmp_path):
    (tmp_path / "run.py").write_text(ELSEWHERE)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or "tokenizers" in v}
    command = [sys.executable, "run.py", str(Path(__file__).parents[2]), sf, "op2_ann", "op8_html_text", "op10_byte_bpe"]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
