import random
from collections import Counter

import numpy as np
import xxhash

from cairn.llm import simhash as S
from cairn.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = {k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = list(fps)
    for i in keys:
        for j in keys[:i]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i in keys:
        ids.setdefault(top(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((rows[i][0], fps[i], low[top(i)]) for i in keys)


def found(docs):
    return Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in S.near_duplicates(docs).collect())


def test_equals_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert found(docs) == brute(rows)


def test_chains_of_close_fingerprints(spark):
    rng = random.Random(7)
    members = {rng.getrandbits(64)}
    for _ in range(300):
        members.add(rng.choice(sorted(members)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)))
    members = np.array(sorted(members), dtype=np.uint64)

    def classes(links):
        parent = {int(m): int(m) for m in members}

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return {m: top(m) for m in parent}

    pairs = [(int(a), int(b)) for a in members for b in members if a < b and bin(int(a) ^ int(b)).count("1") <= 2]
    a, b = S.bucket_links(members)
    assert classes(zip(a.tolist(), b.tolist())) == classes(pairs)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in out} == {(i, top(i)) for i in range(400) if top(i) != i}


def test_one_of_each_group_stays(documents, odd, empty):
    for docs in (documents, odd):
        out = S.keep_one(docs)
        assert out.columns == docs.columns
        roots = {r["root"] for r in S.near_duplicates(docs).collect()}
        assert out.count() == len(roots)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
