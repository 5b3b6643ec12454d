import re
from collections import Counter

from cairn.llm import quality_rules as Q

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        texts = Counter(brute(r["text"]) for r in docs.select("text").collect())
        rows = Q.rate(docs).collect()
        assert Counter(tuple(r[f] for f in FIELDS) for r in rows) == texts
        for r in rows:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def test_kept_rows_are_unchanged(documents, odd, empty):
    for docs in (documents, odd):
        out = Q.keep_good(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = Counter(r["doc_id"] for r in Q.rate(docs).filter("kept").collect())
        assert Counter(r["doc_id"] for r in out.collect()) == kept
    assert Q.rate(empty).count() == 0 and Q.keep_good(empty).count() == 0


def test_a_rule_can_be_added(documents):
    none = Q.rate(documents, rules=(Q.Rule("n_words", low=10**9, from_words=0),))
    assert none.filter("kept").count() == 0


def test_no_python_in_the_plan(documents):
    plan = Q.rate(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
