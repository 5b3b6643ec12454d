import random
from collections import Counter

import pytest

from cairn.llm import suffix_dedup as D
from cairn.llm.gsaca import lcp_array, suffix_array


@pytest.mark.parametrize("symbols", [1, 2, 3, 50])
def test_suffix_array_and_lcp(symbols):
    rng = random.Random(symbols)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 200]:
        for _ in range(30):
            s = [rng.randint(1, symbols) for _ in range(n)]
            if n > 20:
                s = s + s[: n // 2] + s
            order = suffix_array(s)
            assert order == sorted(range(len(s)), key=lambda i: s[i:])
            lcp = lcp_array(s, order)
            for k in range(1, len(order)):
                a, b = s[order[k - 1] :], s[order[k] :]
                assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def check(docs, length=200, gram=32, crowd=D.CROWD):
    rows = docs.select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = Counter((r["doc_id"], len(t), *x) for r, t, x in zip(rows, texts, brute(texts, length)))
    got = Counter()
    for r in D.remove_repeats(docs, length, gram, crowd).collect():
        got[r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])] += 1
    assert got == want


def test_documents_equal_brute_force(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert D.remove_repeats(empty).count() == 0 and D.cut_texts(empty).count() == 0
    out = D.cut_texts(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() == odd.count()


@pytest.mark.parametrize("crowd", [D.CROWD, 3])
def test_edits_overlaps_and_shared_passages(spark, crowd):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice(base) if rng.random() < 0.4 else " ".join(word() for _ in range(25)) for _ in range(4)]
        text = " ".join(p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] for p in parts)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyz") + text[k + 1 :]
        rows.append((i, text))
    rows += [(1000, "ab" * 300), (1001, "a" * 500), (1002, "abc " * 130 + "x" + "abc " * 10), (1003, rows[0][1]), (1004, "é" * 99)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 60, 12, crowd)


@pytest.mark.parametrize(("length", "gram", "crowd"), [(200, 32, 2), (200, 32, 20), (60, 12, 1)])
def test_crowds_are_split_until_they_fit(spark, length, gram, crowd):
    rng = random.Random(crowd)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, edges = text(260), [text(90) for _ in range(5)]
    rows = []
    for i in range(240):
        a, b = rng.randint(0, 60), rng.randint(0, 60)
        before, after = rng.choice(edges)[a:], rng.choice(edges)[: 90 - b]
        rows.append((i, text(rng.randint(0, 150)) + before + common[rng.choice([0, 0, 20]) :] + after + text(rng.randint(0, 150))))
    rows += [(1000 + i, text(120) + common[:190] + text(120)) for i in range(40)]
    rows += [rows[3], rows[3], (2000, rows[5][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), length, gram, crowd)
