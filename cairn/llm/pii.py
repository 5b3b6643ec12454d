"""Information-theoretic sanitisation of personal data, native columns only.

Base spans come from four patterns. Their matches are the protected entities.
The words of a document that holds an entity are candidate terms; over all documents

    PMI(e, t) = log(N n(e, t) / (n(e) n(t)))   and   IC(e) = log(N / n(e))

count documents: n(e, t) those that hold both, n(t) those that hold t. PMI / IC
is the share of what is secret about e that t gives away, 1 for a term that occurs
with e alone. Every pair is scored, from one document up: terms are generalised
from a share of ``GENERALISE`` on and removed from ``REMOVE`` on, at all their places
in the documents that hold that entity. With r = n(t) / n(e, t) a share of 1 - 1/k
means N / n(e) >= r ** k, so thresholds are whole powers and rounding decides
nothing. What chance explains gives nothing away: n(e, t) documents fall together
by chance with a probability of about exp(-n(e, t) PMI), which has to lie below
``CHANCE``; in a handful of documents every word is rare. Texts without an entity
are never changed.

Entities of the same documents have the same counts with every term, so they
are scored as one class. As n(e, t) is n(e) at most, only terms of up to
N (n(e) / N) ^ GENERALISE documents can disclose e; no other pair is built.

Positions: a pattern's matches are fenced with U+0001, the text is split there,
and piece lengths are summed in blocks, so a text with k matches costs O(k).

Defined results: a null or empty text has no spans; rows that agree in id and
text share their spans and count once in n(e) and n(e, t), as rows in N and n(t);
an empty table gives an empty result; texts are read whole, however long; other
columns are left alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, checkpoint, once, text_of

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns, with possessive repeats and look-behinds that forbid
#: starts inside a run; both leave the leftmost matches as they are.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind's.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
FENCE = "\u0001"
BLOCK = 64

#: Shares 1 - 1/k by their k: 0.75 and 0.95.
GENERALISE, REMOVE, CHANCE = 4, 20, 0.01
#: Terms: tokens of letters alone, but for dots at their end.
TOKEN = r"[\p{L}\p{N}@._%+-]"
TERM = rf"(?<!{TOKEN})\p{{L}}{{3,}}+(?=[.]*+(?!{TOKEN}))"
WORD = r"\p{L}{3,}+"
ACTS = ("generalised", "removed")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return _total(F.transform(F.sequence(F.lit(1), F.length(digits)), part)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        above = r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9]|[1-9][0-9]{3,})(?=\.|$)"
        return ~x.rlike(above)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, x: Column) -> Column:
    value = F.lower(x) if kind == "email" else F.regexp_replace(x, "[^0-9.]" if kind == "ip" else "[^0-9]", "")
    return F.xxhash64(F.lit(kind), value)


def _fenced(text: Column, pattern: str) -> Column:
    """Odd elements are the pattern's matches, even ones what lies between."""
    return F.split(F.regexp_replace(text, pattern, f"{FENCE}$0{FENCE}"), FENCE)


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__pii_spans`` (start, rank, end, entity) and, where there are any, ``__pii_words`` (term, start, end)."""
    scan = F.translate(text_of(text), FENCE, "\u0002")
    docs = docs.withColumn("__pii_text", once(scan))
    t = F.col("__pii_text")
    hint = {k: t.contains("@") if k == "email" else t.rlike(HINTS[k]) for k in KINDS}
    docs = docs.withColumns({f"__pii_p_{k}": once(F.when(hint[k], _fenced(t, PATTERNS[k]))) for k in KINDS})
    def blocks(lengths: Column) -> Column:
        n = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(
            F.sequence(F.lit(0), n),
            zero,
            lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))),
        )

    def measured(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Lengths of the pieces, and where each block of them starts."""
        lengths = lambda k: F.when(F.size(f"__pii_p_{k}") > 1, F.transform(f"__pii_p_{k}", F.length))
        docs = docs.withColumns({f"__pii_l_{k}": once(lengths(k)) for k in kinds})
        return docs.withColumns({f"__pii_b_{k}": once(blocks(F.col(f"__pii_l_{k}"))) for k in kinds})

    def start_of(kind: str, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.col(f"__pii_b_{kind}")[block] + _total(F.slice(f"__pii_l_{kind}", block * BLOCK + 1, i % BLOCK))

    docs = measured(docs, KINDS)

    def found(kind: str) -> Column:
        pieces, lengths = F.col(f"__pii_p_{kind}"), F.col(f"__pii_l_{kind}")

        def one(x: Column, i: Column) -> Column:
            start = start_of(kind, i)
            return F.struct(
                start.alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (start + F.length(x)).alias("end"),
                _entity(kind, x).alias("entity"),
            )

        indexed = F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & _valid(kind, x), one(x, i)))
        return F.coalesce(F.when(lengths.isNotNull(), F.filter(indexed, lambda s: s.isNotNull())), F.array())

    docs = docs.withColumns({f"__pii_s_{k}": once(found(k)) for k in KINDS})
    full = F.array_sort(F.concat(*(F.col(f"__pii_s_{k}") for k in KINDS)))
    docs = docs.withColumn("__pii_spans", once(full))
    docs = docs.withColumn("__pii_p_word", once(F.when(F.size("__pii_spans") > 0, _fenced(t, TERM))))
    docs = measured(docs, ("word",))

    def word(x: Column, i: Column) -> Column:
        start = start_of("word", i)
        return F.when(i % 2 == 1, F.struct(F.lower(x).alias("term"), start.alias("start"), (start + F.length(x)).alias("end")))

    words = F.filter(F.transform("__pii_p_word", word), lambda s: s.isNotNull())
    return docs.withColumn("__pii_words", once(F.when(F.col("__pii_l_word").isNotNull(), words)))


def analyse(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Small tables: every row's spans, and the term spans of each ``(id, hash)``."""
    key = [F.col("doc_id"), F.xxhash64(text_of()).alias("text_hash")]
    found = spans_of(docs.select("doc_id", "text"))
    rows = scratch.keep("rows", found.select(*key, F.col("__pii_spans").alias("spans"), F.col("__pii_words").alias("words")))
    id_or = F.coalesce("doc_id", F.lit(-(1 << 63)))
    owners = rows.filter(F.size("spans") > 0).select(id_or.alias("k"), "text_hash", "spans", "words")
    owners = scratch.keep("owners", owners.dropDuplicates(["k", "text_hash"]))
    total = float(max(1, rows.count()))
    holds = owners.select("k", "text_hash", F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity"))
    # Entities of the same documents make a class, known by their number and two hashes.
    both = [F.bit_xor(F.xxhash64(F.lit(seed), "k", "text_hash")).alias(f"h{seed}") for seed in (1, 2)]
    # Counts are kept before they are joined, so that joins of a common entity or term can be split.
    classes = scratch.keep("classes", holds.groupBy("entity").agg(F.count("*").alias("n_e"), *both))
    holds = holds.join(classes.filter(F.col("n_e") < total), "entity").select("k", "text_hash", "n_e", "h1", "h2").distinct()
    holds = scratch.keep("holds", holds)
    most = lambda n_e: total * F.pow(n_e / total, F.lit(1 - 1 / GENERALISE)) * (1 + 1e-9)
    top = holds.agg(F.max(most(F.col("n_e")))).first()[0] or 0.0
    held = owners.select("k", "text_hash", F.explode(F.array_distinct(F.transform("words", lambda x: x["term"]))).alias("term"))
    words = docs.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(WORD), F.lit(0)))).alias("term")
    )
    n_term = scratch.keep("n_term", words.groupBy("term").agg(F.count("*").alias("n_t")))
    # A term that the lower case of its whole text writes otherwise has no count but n(e, t).
    held = held.join(n_term, "term", "left").fillna({"n_t": 1}).filter(F.col("n_t") <= top)
    pairs = scratch.keep("pairs", held.join(holds, ["k", "text_hash"]).filter(F.col("n_t") <= most(F.col("n_e"))))
    counts = pairs.groupBy("n_e", "h1", "h2", "term", "n_t").agg(F.count("*").alias("n_et"))
    n_t = F.greatest("n_t", "n_et").cast("double")
    pmi = F.log(F.lit(total) * F.col("n_et") / (F.col("n_e") * n_t))
    counts = counts.withColumns({"rarity": total / F.col("n_e"), "r": n_t / F.col("n_et"), "pmi": pmi})
    disclosing = (
        counts.filter((F.col("rarity") >= _power(F.col("r"), GENERALISE)) & (F.col("n_et") * F.col("pmi") > -math.log(CHANCE)))
        .select("n_e", "h1", "h2", "term", F.when(F.col("rarity") >= _power(F.col("r"), REMOVE), "removed").otherwise("generalised").alias("act"))
    )
    disclosing = scratch.keep("disclosing", disclosing)
    acts = pairs.join(disclosing, ["n_e", "h1", "h2", "term"]).groupBy("k", "text_hash", "term")
    acts = acts.agg(F.max("act").alias("act"))  # removed outranks generalised
    terms = (
        owners.select("k", "text_hash", F.explode("words").alias("x")).select("k", "text_hash", "x.*")
        .join(acts, ["k", "text_hash", "term"])
        .groupBy("k", "text_hash")
        .agg(F.collect_list(F.struct("start", "end", "act")).alias("terms"))
    )
    return rows.withColumn("k", id_or), checkpoint(terms)


def _power(r, k: int):
    """``r ** k`` by squaring, the same in every engine; for columns and SQL."""
    mul = (lambda a, b: f"({a}) * ({b})") if isinstance(r, str) else (lambda a, b: a * b)
    out = None
    while k:
        if k & 1:
            out = r if out is None else mul(out, r)
        r, k = mul(r, r), k >> 1
    return out


def _all_spans(spans: Column, terms: Column) -> Column:
    base = F.transform(
        spans,
        lambda s: F.struct(s["start"], s["rank"], s["end"], F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind")),
    )
    more = F.transform(
        F.coalesce(terms, F.array()),
        lambda x: F.struct(x["start"], F.lit(len(KINDS)).alias("rank"), x["end"], x["act"].alias("kind")),
    )
    return F.array_sort(F.concat(base, more))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans and all spans, as sorted structs."""
    with Scratch(docs.sparkSession) as scratch:
        rows, terms = analyse(docs, scratch)
        found = checkpoint(
            rows.join(terms, ["k", "text_hash"], "left").select("doc_id", "spans", _all_spans(F.col("spans"), F.col("terms")).alias("found"))
        )
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    acted = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.array_join(F.transform(base, name), ",").alias("base"),
        F.array_join(F.transform("found", name), ",").alias("spans"),
        (F.size("found") - F.size("spans")).cast("long").alias("n_terms"),
        *(acted(kind).alias(f"n_{kind}") for kind in ACTS),
        F.size("found").cast("long").alias("n_spans"),
    )


def mask(text: Column, spans: Column) -> Column:
    """``text`` with its sorted spans replaced by their labels; overlaps merge."""
    label = lambda s: reduce(lambda a, k: a.when(s["kind"] == k, LABELS[k]), LABELS, F.when(F.lit(False), ""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["done"], piece, label(s))).otherwise(acc["done"]).alias("done"),
        )

    end = lambda acc: F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def sanitise_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts sanitised, other columns unchanged."""
    with Scratch(docs.sparkSession) as scratch:
        rows, terms = analyse(docs, scratch)
        spans = checkpoint(
            rows.filter(F.size("spans") > 0)
            .dropDuplicates(["k", "text_hash"])
            .join(terms, ["k", "text_hash"], "left")
            .select(
                F.col("k").alias("__pii_k"), F.col("text_hash").alias("__pii_h"),
                _all_spans(F.col("spans"), F.col("terms")).alias("__pii_found"),
            )
        )
    keyed = docs.withColumns(
        {"__pii_k": F.coalesce(docs["doc_id"], F.lit(-(1 << 63))), "__pii_h": F.xxhash64(text_of())}
    ).join(spans, ["__pii_k", "__pii_h"], "left")
    clean = F.when(F.col("__pii_found").isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col("__pii_found")))
    return keyed.select(*(clean.alias("text") if c == "text" else keyed[c] for c in docs.columns))


#: The kinds' patterns as they are given; SQL needs no guard against going back.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def oracle() -> str:
    """The same in SQL: spans by fenced splits, counts of every entity and term by plain joins."""

    def pieces(pattern: str, source: str) -> str:
        cut = f"string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        return f"""(SELECT r, x, pos - length(x) AS lo, pos AS hi FROM (
          SELECT r, x, i, sum(length(x)) OVER (PARTITION BY r ORDER BY i) AS pos FROM (SELECT r, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT r, {cut} AS p FROM {source}))) WHERE i % 2 = 0)"""

    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({digits}, -i, 1) AS INT)
      ELSE CAST(substr({digits}, -i, 1) AS INT) * 2 - CASE WHEN CAST(substr({digits}, -i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    valid = {
        "email": "TRUE", "ip": r"NOT regexp_matches(x, '(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9]|[1-9][0-9]{3,})(?:\.|$)')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    value = {"email": "lower(x)", "ip": "regexp_replace(x, '[^0-9.]', '', 'g')", "card": digits, "phone": digits}
    base = " UNION ALL ".join(
        f"SELECT r, {rank} AS rank, '{kind}' AS kind, lo, hi, '{kind}:' || {value[kind]} AS entity FROM {pieces(PLAIN[kind], 'd')} WHERE {valid[kind]}"
        for rank, kind in enumerate(KINDS)
    )
    named = "string_agg({0}kind || ':' || {0}lo || ':' || {0}hi, ',' ORDER BY {0}lo, {0}rank, {0}hi)"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k, coalesce(text, '') AS t0, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    base AS MATERIALIZED ({base}),
    firsts AS (SELECT min(r) AS r FROM d GROUP BY k, t0),
    owners AS MATERIALIZED (SELECT r, t FROM d WHERE r IN (SELECT r FROM base) AND r IN (SELECT r FROM firsts)),
    words AS MATERIALIZED (SELECT r, lower(rtrim(x, '.')) AS term, lo, lo + length(rtrim(x, '.')) AS hi FROM {pieces('[\\p{L}\\p{N}@._%+-]+', 'owners')} WHERE regexp_full_match(x, '\\p{{L}}{{3,}}[.]*')),
    total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
    holds AS MATERIALIZED (SELECT DISTINCT r, entity FROM base JOIN owners USING (r)),
    n_e AS (SELECT entity, count(*) AS n_e FROM holds GROUP BY entity HAVING count(*) < (SELECT n FROM total)),
    n_t AS MATERIALIZED (SELECT term, count(*) AS n_t FROM (SELECT r, unnest(list_distinct(regexp_extract_all(lower(t0), '\\p{{L}}{{3,}}'))) AS term FROM d) GROUP BY term),
    pairs AS MATERIALIZED (SELECT r, entity, term FROM holds JOIN (SELECT DISTINCT r, term FROM words) USING (r)),
    counts AS (SELECT entity, term, count(*) AS n_et FROM pairs GROUP BY ALL),
    scored AS (
      SELECT entity, term, n_et, n / n_e AS rarity, big / n_et AS ratio, ln(n * n_et / (n_e * big)) AS pmi
      FROM (SELECT *, CAST(greatest(coalesce(n_t, 1), n_et) AS DOUBLE) AS big FROM counts JOIN n_e USING (entity) LEFT JOIN n_t USING (term)), total),
    disclosing AS (SELECT entity, term, CASE WHEN rarity >= {_power('ratio', REMOVE)} THEN 'removed' ELSE 'generalised' END AS act
      FROM scored WHERE rarity >= {_power('ratio', GENERALISE)} AND n_et * pmi > {-math.log(CHANCE)!r}),
    acts AS (SELECT r, term, max(act) AS act FROM pairs JOIN disclosing USING (entity, term) GROUP BY ALL),
    found AS (SELECT r, rank, kind, lo, hi FROM base JOIN owners USING (r) UNION ALL SELECT r, {len(KINDS)}, act, lo, hi FROM words JOIN acts USING (r, term)),
    texts AS (SELECT r, {named.format('')} AS spans, coalesce({named.format('')} FILTER (rank < {len(KINDS)}), '') AS base, count(*) AS n_spans,
      {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*KINDS, *ACTS))} FROM found GROUP BY r),
    whole AS (SELECT k, t0, texts.* FROM texts JOIN d USING (r))
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in (*KINDS, *ACTS))}, coalesce(n_generalised + n_removed, 0) AS n_terms, coalesce(n_spans, 0) AS n_spans,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN whole USING (k, t0)"""
