"""SimHash near-duplicates: block tables by the pigeonhole principle.

A fingerprint is cut into ``BLOCKS`` blocks. Two fingerprints that differ in at
most ``DISTANCE`` bits agree on all but ``DISTANCE`` blocks, so each distinct
fingerprint is filed once for every choice of blocks left out, and only
fingerprints of one bucket are compared. A bucket's members can differ in the
left-out blocks alone, which bounds it at 2**16 distinct fingerprints whatever
the input. Copies share a fingerprint and are one member.

Defined results: a null, empty or word-free text has fingerprint 0 and links
like any other; equal rows and equal texts share a component; a null doc_id
counts after every other id, and a component of null ids only has a null id;
an empty table gives an empty result; a long text is read as a whole; other columns
are never read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import checkpoint, small_batches, text_of
from cairn.llm.components import components

BITS, BLOCKS, DISTANCE, SHINGLE, SEED = 64, 8, 2, 3, 42
WIDTH = BITS // BLOCKS
#: Buckets up to this size are compared pair by pair, larger ones by masked sorting.
DIRECT = 48


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    values = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(values), 1 << 14):
        part = values[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(texts: pa.Array) -> pa.Array:
    out = np.array([fingerprint(x or "") for x in texts.to_pylist()], dtype=np.uint64)
    return pa.array(out.view(np.int64), pa.int64())


def masks() -> list[int]:
    """For every choice of blocks left out: a signed mask of the kept bits."""
    found = []
    for out in combinations(range(BLOCKS), DISTANCE):
        kept = sum(((1 << WIDTH) - 1) << (WIDTH * b) for b in range(BLOCKS) if b not in out)
        found.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return found


def bucket_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs in one bucket that differ in at most two bits.

    ``members``: distinct uint64. Returns (member, smallest member reached).
    """
    members = np.sort(members)
    n = len(members)
    label = np.arange(n)
    if n <= DIRECT:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(members[a] ^ members[b]) <= DISTANCE
        a, b = a[near], b[near]
        while len(a):
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
    else:
        differ = int(np.bitwise_or.reduce(members ^ members[0]))
        free = [i for i in range(BITS) if differ >> i & 1]
        pairs = list(combinations(free, 2)) if len(free) > 1 else [(i, i) for i in free]
        while True:
            before = label.copy()
            for i, j in pairs:
                # Members equal under the mask differ in bits i and j at most.
                key = members & np.uint64(~((1 << i) | (1 << j)) & (1 << BITS) - 1)
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
                lowest = np.minimum.reduceat(label[order], starts)
                label[order] = np.repeat(lowest, np.diff(np.r_[starts, n]))
            if (label == before).all():
                break
    linked = np.flatnonzero(label != np.arange(n))
    return members[linked], members[label[linked]]


def _links(batches):
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        column = batch.column(0)
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for k in range(len(column)):
            found.append(bucket_links(values[offsets[k] : offsets[k + 1]].view(np.uint64)))
        a = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row, kept in the shared folder."""
    small_batches(docs.sparkSession)
    of = F.arrow_udf(fingerprints, T.LongType())
    return checkpoint(docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), of(text_of()).alias("fp")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, component_id, root``."""
    rows = with_fingerprints(docs)
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    # A fingerprint makes 28 rows, so they are dealt out by their number, not by their bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = (
        distinct.repartition(tasks, "fp").select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks()))).alias("t", "key"))
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
    )
    links = buckets.select("members").mapInArrow(_links, "a long, b long")
    roots = components(links)
    classes = checkpoint(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    )
    # Kept before the join, so that a join of one large component can be split.
    named = checkpoint(classes.groupBy("root").agg(F.min("lowest").alias("component_id")))
    classes = checkpoint(classes.join(named, "root").select("fp", "root", "component_id"))
    return rows.join(classes, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with its columns unchanged."""
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("__sh_id"), F.col("first.text_hash").alias("__sh_hash")
    )
    rows = docs.withColumn("__sh_own", F.xxhash64(text_of()))
    same = rows["doc_id"].eqNullSafe(F.col("__sh_id")) & (F.col("__sh_own") == F.col("__sh_hash"))
    return (
        rows.join(kept.distinct(), same, "left_semi").dropDuplicates(["doc_id", "__sh_own"]).select(*docs.columns)
    )


#: Fixed values of the published hash function.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
WHOLE = 1 << 64


def xxh64_sql(source: str, seed: int = SEED) -> str:
    """``s, h`` of ``source(s)``: the hash of every text, from its published definition."""
    p1, p2, p3, p4, p5 = PRIMES
    times = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) * {b}) % {WHOLE} AS UBIGINT)"
    plus = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {WHOLE} AS UBIGINT)"
    turn = lambda x, n: f"((({x} & {(1 << (64 - n)) - 1}) << {n}) | ({x} >> {64 - n}))"

    def lane(at: str, size: int) -> str:
        return "CAST('0x' || " + " || ".join(f"substr(hx, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)" for k in reversed(range(size))) + " AS UBIGINT)"

    def mixed(sql: str, keep: str, name: str, at: str) -> str:
        """One stripe's eight bytes into accumulator ``name``."""
        sql = f"SELECT {keep}, {plus(name, times(lane(at, 8), p2))} AS x FROM ({sql})"
        return f"SELECT {keep}, {times(turn('x', 31), p1)} AS x FROM ({sql})"

    keep = "s, hx, n, i, v1, v2, v3, v4"
    stripe = f"SELECT {keep} FROM stripes WHERE 32 * (i + 1) <= n"
    for k in range(4):
        new = mixed(stripe, keep, f"v{k + 1}", f"32 * i + {8 * k}")
        stripe = f"SELECT {', '.join('x AS v' + str(k + 1) if c == f'v{k + 1}' else c for c in keep.split(', '))} FROM ({new})"
    start = [(seed + p1 + p2) % WHOLE, (seed + p2) % WHOLE, seed, (seed - p1) % WHOLE]
    merged = f"SELECT s, hx, n, 32 * i AS pos, v1, v2, v3, v4, {plus(plus(turn('v1', 1), turn('v2', 7)), plus(turn('v3', 12), turn('v4', 18)))} AS h FROM stripes WHERE i > 0 AND 32 * (i + 1) > n"
    for k in range(4):
        merged = f"SELECT s, hx, n, pos, v1, v2, v3, v4, h, {times(f'v{k + 1}', p2)} AS x FROM ({merged})"
        merged = f"SELECT s, hx, n, pos, v1, v2, v3, v4, {plus(times(f'xor(h, {times(turn(chr(120), 31), p1)})', p1), p4)} AS h FROM ({merged})"
    short = f"SELECT s, hx, n, CAST(0 AS BIGINT) AS pos, CAST({(seed + p5) % WHOLE} AS UBIGINT) AS h FROM stripes WHERE i = 0 AND n < 32"
    sql = f"SELECT s, hx, n, pos, {plus('h', 'n')} AS h FROM (SELECT s, hx, n, pos, h FROM ({merged}) UNION ALL {short})"
    for size, most in ((8, 3), (4, 1), (1, 3)):
        for _ in range(most):
            some = f"pos + {size} <= n"
            value = lane("pos", size)
            if size == 8:
                sql = f"SELECT *, CASE WHEN {some} THEN {times(value, p2)} ELSE 0 END AS x FROM ({sql})"
                mixed_in, spin, by, more = times(turn("x", 31), p1), 27, p1, p4
            else:
                sql = f"SELECT *, CASE WHEN {some} THEN {times(value, p1 if size == 4 else p5)} ELSE 0 END AS x FROM ({sql})"
                mixed_in, spin, by, more = "x", 23 if size == 4 else 11, p2 if size == 4 else p1, p3 if size == 4 else 0
            sql = f"SELECT s, hx, n, pos, h, xor(h, {mixed_in}) AS y FROM ({sql})"
            sql = f"SELECT s, hx, n, CASE WHEN {some} THEN pos + {size} ELSE pos END AS pos, CASE WHEN {some} THEN {plus(times(turn('y', spin), by), more)} ELSE h END AS h FROM ({sql})"
    for shift, by in ((33, p2), (29, p3), (32, None)):
        value = f"xor(h, h >> {shift})"
        sql = f"SELECT s, {times(value, by) if by else value} AS h FROM ({sql})"
    return f"""(WITH RECURSIVE stripes AS (
      SELECT s, hx, n, CAST(0 AS BIGINT) AS i, {', '.join(f'CAST({v} AS UBIGINT) AS v{k + 1}' for k, v in enumerate(start))}
      FROM (SELECT s, hex(encode(s)) AS hx, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM ({source}))
      UNION ALL SELECT s, hx, n, i + 1, v1, v2, v3, v4 FROM ({stripe}))
      {sql})"""


def oracle() -> str:
    """The same in SQL: fingerprints from the hash's definition, links by comparing all, components by reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN CAST({1 << k} AS UHUGEINT) ELSE 0 END" for k in range(BITS))
    return f"""
    WITH RECURSIVE w AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS MATERIALIZED (
      SELECT r, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s
      FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE - 2}))) AS i FROM w WHERE len(ws) > 0)),
    hashes AS MATERIALIZED (SELECT * FROM {xxh64_sql('SELECT DISTINCT s FROM g')}),
    f AS (SELECT r, CAST({bits} AS UBIGINT) AS fp FROM g JOIN hashes USING (s) GROUP BY r),
    docs AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0) AS fp FROM w LEFT JOIN f USING (r)),
    known AS MATERIALIZED (SELECT fp, min(doc_id) AS lowest FROM docs GROUP BY fp),
    links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM known a JOIN known b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {DISTANCE}),
    reach AS (SELECT fp AS a, fp AS b FROM known UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    named AS (SELECT a AS fp, min(lowest) AS component_id FROM reach JOIN known ON b = fp GROUP BY a)
    SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM docs JOIN named USING (fp)"""
