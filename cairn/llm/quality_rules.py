"""Quality rules: one Spark projection compiled from a table of thresholds.

No user functions. ``measure`` adds the counts of every text, ``verdict``
compiles ``RULES`` into a single boolean expression over them.

Defined results: a null or empty text has no words, so every count is 0,
``base_failed`` is true and ``kept`` false. Repeated rows each give their own
row; an empty table gives an empty result; no text is too long; other columns are left alone, and
internal columns carry the prefix ``__qr_``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE, once, text_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have he her his in is it not of on or that the this to was were "
    "which with you "
    "au avec ce dans de des du elle en est et il je la le les ne nous ou par pas pour que qui sur un une vous "
    "auf aus das dem den der die ein eine einen er es für ich im ist mit nicht sein sich sie und von zu "
    "al con del el ella los las más no para pero por se son su sus una unos y"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``, asked of texts of at least ``from_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 1


#: The threshold table. Ratios follow widely published web-text filters.
RULES = (
    Rule("n_words", low=10, from_words=0),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.01, from_words=50),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.2),
)


def metrics() -> dict[str, Column]:
    """Every ratio a rule may name, over the counts of ``measure``."""
    words = F.greatest(F.col("__qr_n_words"), F.lit(1))
    return {
        "n_words": F.col("__qr_n_words"),
        "mean_word_chars": F.col("__qr_word_chars") / words,
        "symbols_per_word": F.col("__qr_n_symbols") / words,
        "stop_word_ratio": F.col("__qr_n_stop") / words,
        "dup_line_ratio": F.col("__qr_n_dup_lines") / F.greatest(F.col("__qr_n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("__qr_n_repeat_words") / words,
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text in ``__qr_`` columns."""
    c = F.col
    word, n = c("__qr_words"), c("__qr_n_words")
    docs = docs.withColumn("__qr_text", text_of(text))
    docs = docs.withColumns(
        {
            "__qr_words": once(F.array_remove(F.split("__qr_text", f"{SPACE}+"), "")),
            "__qr_lines": F.filter(F.split("__qr_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__qr_n_symbols": F.length("__qr_text") - F.length(F.translate("__qr_text", "#*$%&|<>", "")),
            "__qr_word_chars": F.length(F.regexp_replace("__qr_text", f"{SPACE}+", "")),
        }
    )
    docs = docs.withColumn("__qr_n_words", F.size(word).cast("long"))
    # A window is known by a 64-bit hash chained over its words.
    docs = docs.withColumns(
        {
            "__qr_grams": once(
                F.transform(
                    F.slice(word, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)).cast("int")),
                    lambda w, i: F.xxhash64(w, *(word[i + k] for k in range(1, WINDOW))),
                )
            ),
            "__qr_n_lines": F.size("__qr_lines").cast("long"),
            "__qr_n_dup_lines": (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long"),
            "__qr_n_stop": F.size(F.filter(word, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        }
    )
    # Only texts with a repeated window are sorted.
    grams = c("__qr_grams")
    docs = docs.withColumn(
        "__qr_sorted",
        once(
            F.when(
                F.size(F.array_distinct(grams)) < F.size(grams),
                F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            )
        ),
    )
    rows = c("__qr_sorted")
    docs = docs.withColumn(
        "__qr_starts",
        once(
            F.sort_array(
                F.transform(
                    F.filter(
                        rows,
                        lambda x, i: ((i > 0) & (F.get(rows, i - 1)["h"] == x["h"]))
                        | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            )
        ),
    )
    starts = c("__qr_starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return docs.withColumn("__qr_n_repeat_words", once(F.coalesce(covered, F.lit(0)).cast("long")))


def base_failed() -> Column:
    n = F.col("__qr_n_words")
    return (n < 10) | (100 * F.col("__qr_n_repeat_words") > 20 * n)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    known = metrics()

    def holds(rule: Rule) -> Column:
        value, ok = known[rule.metric], F.lit(True)
        if rule.low is not None:
            ok = ok & (value >= rule.low)
        if rule.high is not None:
            ok = ok & (value <= rule.high)
        return ok | (F.col("__qr_n_words") < rule.from_words)

    return reduce(lambda a, b: a & b, map(holds, rules), ~base_failed())


def rate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, ratios and verdict."""
    count = lambda name: F.col(f"__qr_{name}").cast("long").alias(name)
    return measure(docs.select("doc_id", "text")).select(
        "doc_id",
        *map(count, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")),
        base_failed().alias("base_failed"),
        verdict(rules).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    return measure(docs).filter(verdict(rules)).select(*(docs[name] for name in docs.columns))


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    WITH w AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM documents),
    g AS (
      SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
    d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM g) WHERE k > 1),
    s AS (
      SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS covered
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
    m AS (
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop
      FROM w LEFT JOIN s USING (r)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, base_failed,
           NOT base_failed AND n_words >= 10
           AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15
           AND n_symbols / greatest(n_words, 1) <= 0.1
           AND (n_words < 50 OR n_stop / greatest(n_words, 1) >= 0.01)
           AND n_dup_lines / greatest(n_lines, 1) <= 0.5
           AND n_repeat_words / greatest(n_words, 1) <= 0.2 AS kept
    FROM b
    """
