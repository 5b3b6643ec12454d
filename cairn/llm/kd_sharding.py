"""K-d tree sharding by distributed weighted medians, native columns only.

The units are groups of equal texts, weighted by their bytes, so a group stays
in one shard. A group with more than 1 / ``SPLIT`` of a shard's bytes or rows is
cut into units by doc_id, weighted by the rows that fall in each. Source and
language count by the rank of the whole value among all, the length by its
logarithm, and every dimension is scaled to its range over all units. Each level
of the tree takes, per node, the dimension with the widest spread and cuts where
the weight on the left comes nearest to the share of the node's left shards.
Medians come from radix histograms of 48-bit keys (value, then length and a hash
that break ties), three rounds of 16 bits each, summed in Spark; the driver sees
one row a node. All of it is integer arithmetic over MD5 and so has an SQL form.

Defined results: a null text has size 1 and the checksum of no bytes; null
metadata sorts lowest; equal rows are numbered copies with slots of their own; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, checkpoint, fits, text_of

SHARDS = 16
#: Groups of equal texts above this part of a shard are cut, so at most ``2 * SHARDS * SPLIT`` of them.
SPLIT = 20
#: Hex digits of a hash that tell the units of a group that is cut, the buckets of slots, the group.
PART, BUCKET, GROUP = 5, 3, 15
DIMS = ("d_source", "d_lang", "d_length")
#: The dimensions that are ranks, by their column.
RANKED = {"d_source": "source", "d_lang": "lang"}
#: Bits of a key: value, length, tie.
VALUE, LENGTH, TIE = 16, 12, 20
ROUNDS, DIGIT = 3, 16


def _hash(text: Column, digits: int, at: int = 1) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), at, digits), 16, 10).cast("long")


def rows(docs: DataFrame) -> DataFrame:
    """Every row once, copies numbered: sizes, checksums, group and own hash, dimensions."""
    t = text_of()
    size = (F.octet_length(t) + 1).cast("long")
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        _hash(t, GROUP).alias("group"),
        *(F.coalesce(F.col(col).cast("string"), F.lit("")).alias(dim) for dim, col in RANKED.items()),
    )
    # Copies are counted before they meet, and dealt out by their number.
    counted = whole.groupBy(*whole.columns).agg(F.count("*").alias("n"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    bits = F.length(F.bin("size")) - 1
    log = bits * 65536 + F.expr("size * 65536 div shiftleft(1L, length(bin(size)) - 1)") - 65536
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy")
    return numbered.withColumns({"d_length": log.cast("long"), "own": _hash(own, PART), "bucket": _hash(own, BUCKET, PART + 1)})


def _ranked(units: DataFrame, dim: str) -> DataFrame:
    """``units`` with the strings of ``dim`` replaced by their rank."""
    values = units.groupBy(dim).agg(F.count("*").alias("n")).select(dim)
    ranged = checkpoint(values.repartitionByRange(dim).withColumn("p", F.spark_partition_id()))
    counts = ranged.groupBy("p").agg(F.count("*").alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("p").orderBy(dim)) - 1
    ranks = checkpoint(ranged.join(F.broadcast(starts), "p").select(dim, rank.cast("long").alias("rank")))
    if fits(ranks, dim):
        ranks = F.broadcast(ranks)
    return units.join(ranks, dim).drop(dim).withColumnRenamed("rank", dim)


def _units(placed: DataFrame) -> DataFrame:
    """Units with weight and tie break, every dimension scaled to ``VALUE`` bits, the length to ``LENGTH`` bits too."""
    units = placed.groupBy("group", "text_crc32", "part").agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in DIMS))
    for dim in RANKED:
        units = _ranked(units, dim)
    units = checkpoint(units)
    ends = units.agg(*(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max)))).first()

    def scaled(d: str, bits: int) -> Column:
        low, high = ends[f"low_{d}"] or 0, ends[f"high_{d}"] or 0
        return F.expr(f"({d} - {low}L) * {(1 << bits) - 1}L div {max(1, high - low)}L")

    tie = _hash(F.concat_ws(":", "group", "part"), TIE // 4)
    return units.withColumns({**{d: scaled(d, VALUE) for d in DIMS}, "span": scaled("d_length", LENGTH), "tie": tie})


def _medians(placed: DataFrame, nodes: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """For each node (weight, left shards, shards) the largest key that goes left."""
    prefix, before, last = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), {}
    for k in range(ROUNDS):
        low = DIGIT * (ROUNDS - 1 - k)
        here = F.create_map(*(F.lit(x).cast("long") for n in nodes for x in (n, prefix[n])))
        inside = placed.filter(F.shiftright("key", low + DIGIT) == here[F.col("node")]) if k else placed
        bins = inside.groupBy("node", F.shiftright("key", low).alias("bin")).agg(F.sum("weight").alias("w"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        # What is still wanted on the left, times the node's shards. A node has 2 ** DIGIT bins a round at most.
        want = F.create_map(*(F.lit(x).cast("long") for n, (w, left, count) in nodes.items() for x in (n, w * left - before[n] * count)))
        count = F.create_map(*(F.lit(x).cast("long") for n in nodes for x in (n, nodes[n][2])))
        reached = F.col("sum") * count[F.col("node")] >= want[F.col("node")]
        cut = bins.withColumn("sum", F.sum("w").over(upto)).groupBy("node").agg(F.min(F.when(reached, F.struct("bin", "sum", "w"))).alias("at"))
        for row in cut.collect():
            n, at = row["node"], row["at"]
            prefix[n], before[n], last[n] = at["bin"], before[n] + at["sum"] - at["w"], at["w"]
    # The unit at the cut goes where the left side comes nearer to its share.
    return {
        n: prefix[n] if 2 * (w * left - before[n] * count) >= last[n] * count else prefix[n] - 1
        for n, (w, left, count) in nodes.items()
    }


def assign(units: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """``units`` with a ``shard``: the leaf of the k-d tree they fall in."""
    leaves: dict[int, tuple[int, int]] = {1: (0, shards)}  # node: first shard, number of shards
    units, level = units.withColumn("node", F.lit(1).cast("long")), 0
    here = F.col("node")
    while any(count > 1 for _, count in leaves.values()):
        spread = units.groupBy("node").agg(F.sum("weight").alias("w"), *((F.max(d) - F.min(d)).alias(d) for d in DIMS))
        seen = {r["node"]: r for r in spread.collect()}  # a row a node
        grown, wanted, dims = dict(leaves), {}, {}
        for n, (first, count) in leaves.items():
            if count == 1:
                continue
            left = count // 2
            del grown[n]
            grown[2 * n], grown[2 * n + 1] = (first, left), (first + left, count - left)
            if n in seen:
                dims[n] = max(DIMS, key=lambda d, r=seen[n]: (r[d], -DIMS.index(d)))
                wanted[n] = seen[n]["w"], left, count
        leaves = grown
        if not wanted:
            break
        value = reduce(lambda a, n: a.when(here == n, F.col(dims[n])), wanted, F.when(F.lit(False), F.lit(0).cast("long")))
        key = value * F.lit(1 << (LENGTH + TIE)) + F.col("span") * F.lit(1 << TIE) + F.col("tie")
        units = scratch.keep(f"keyed{level}", units.withColumn("key", key))
        cuts = _medians(units.filter(F.col("key").isNotNull()), wanted)
        cut = F.create_map(*(F.lit(x).cast("long") for n in cuts for x in (n, cuts[n])))
        below = F.when(F.col("key") <= cut[here], 0).otherwise(1)
        units = units.withColumn("node", F.when(F.col("key").isNotNull(), here * 2 + below).otherwise(here)).drop("key")
        level += 1
    lookup = F.create_map(*(x for n, (first, _) in leaves.items() for x in (F.lit(n).cast("long"), F.lit(first))))
    return units.withColumn("shard", lookup[here])


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document with its shard and its slot in it."""
    spark, unit = docs.sparkSession, ["group", "text_crc32", "part"]
    with Scratch(spark) as scratch:
        base = checkpoint(rows(docs))
        whole = base.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
        over = (F.sum("size") * shards * SPLIT > (whole["size"] or 0)) | (F.count("*") * shards * SPLIT > whole["n"])
        heavy = base.groupBy("group", "text_crc32").agg(over.alias("heavy")).filter("heavy")
        # At most ``SPLIT`` groups a shard are too large, and as many too many.
        cut = base.join(F.broadcast(checkpoint(heavy)), ["group", "text_crc32"], "left")
        placed = checkpoint(cut.withColumn("part", F.when(F.col("heavy"), F.col("own")).otherwise(F.lit(-1).cast("long"))).drop("heavy", "own"))
        units = scratch.keep("units", _units(placed))
        leaf = checkpoint(assign(units, shards, scratch).select(*unit, F.col("shard").cast("int")))
    placed = placed.drop(*DIMS).join(leaf, unit)
    placed = checkpoint(placed)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group", "text_crc32", "copy")
    # ``starts`` has shards x 16 ** BUCKET rows at most, whatever the input.
    return (
        placed.withColumn("n", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def crc32_sql(source: str) -> str:
    """``id, crc`` of ``source(id, hx)``, hex digits of any length.

    A checksum is linear: blocks are summed up on their own, moved on by the
    bytes after them, and added without carry.
    """
    poly, block = 0xEDB88320, 32

    def moved(x: int, zeros: int) -> int:
        for _ in range(8 * zeros):
            x = x >> 1 ^ (poly if x & 1 else 0)
        return x

    table = "[" + ", ".join(str(moved(i, 1)) for i in range(256)) + "]"
    steps = [[moved(1 << i, 1) for i in range(32)]]  # for 1, 2, 4, ... bytes
    times = lambda m, x: [_fold(m, v) for v in x]
    for _ in range(39):
        steps.append(times(steps[-1], steps[-1]))

    def shift(x: str, zeros: str, sql: str, keep: str) -> str:
        for j, m in enumerate(steps[:36]):
            product = " # ".join(f"(({x} >> {i}) & 1) * {c}" for i, c in enumerate(m)).split(" # ")
            whole = product[0]
            for p in product[1:]:
                whole = f"xor({whole}, {p})"
            sql = f"SELECT {keep}, {zeros}, CASE WHEN ({zeros} >> {j}) & 1 = 1 THEN {whole} ELSE {x} END AS {x} FROM ({sql})"
        return sql

    sql = f"""SELECT id, k, n, CAST(0 AS BIGINT) AS c, lpad(substr(hx, greatest(1, length(hx) - {2 * block} * (k + 1) + 1), least({2 * block}, length(hx) - {2 * block} * k)), {2 * block}, '0') AS b
      FROM (SELECT *, length(hx) // 2 AS n, unnest(range(greatest(1, (length(hx) + {2 * block - 1}) // {2 * block}))) AS k FROM ({source}))"""
    for i in range(block):
        byte = f"CAST('0x' || substr(b, {2 * i + 1}, 2) AS BIGINT)"
        sql = f"SELECT id, k, n, b, xor(c >> 8, list_extract({table}, CAST(xor(c & 255, {byte}) + 1 AS BIGINT))) AS c FROM ({sql})"
    blocks = shift("c", "z", f"SELECT id, n, c, k * {block} AS z FROM ({sql})", "id, n")
    first = shift("f", "n", "SELECT DISTINCT n, CAST(4294967295 AS BIGINT) AS f FROM sizes", "1 AS one")
    return f"""(WITH blocks AS MATERIALIZED ({blocks}), sizes AS (SELECT DISTINCT n FROM blocks), first AS MATERIALIZED ({first})
      SELECT id, xor(xor(bit_xor(c), any_value(f)), 4294967295) AS crc FROM blocks JOIN first USING (n) GROUP BY id)"""


def _fold(matrix: list[int], x: int) -> int:
    out = 0
    for i, c in enumerate(matrix):
        out ^= c if x >> i & 1 else 0
    return out


def oracle(shards: int = SHARDS) -> str:
    """The same in SQL, for a power of two of shards; medians are plain running sums there."""
    hexed = lambda x, n, at=1: f"CAST('0x' || substr(md5({x}), {at}, {n}) AS BIGINT)"
    own = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy"
    ctes = [
        f"""docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {hexed("coalesce(text, '')", GROUP)} AS grp,
          lower(hex(encode(coalesce(text, '')))) AS hx, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)""",
        f"sums AS MATERIALIZED (SELECT * FROM {crc32_sql('SELECT id, hx FROM docs')})",
        """numbered AS MATERIALIZED (SELECT doc_id, size, crc, grp, source, lang,
          row_number() OVER (PARTITION BY doc_id, size, crc, grp, source, lang) AS copy FROM docs JOIN sums USING (id))""",
        f"""heavy AS (SELECT grp, crc FROM numbered GROUP BY ALL HAVING sum(size) * {shards * SPLIT} > (SELECT sum(size) FROM numbered)
          OR count(*) * {shards * SPLIT} > (SELECT count(*) FROM numbered))""",
        f"""placed AS MATERIALIZED (SELECT *, length(bin(size)) * 65536 - 65536 + size * 65536 // (1 << (length(bin(size)) - 1)) - 65536 AS len,
          CASE WHEN (grp, crc) IN (SELECT (grp, crc) FROM heavy) THEN {hexed(own, PART)} ELSE -1 END AS part, {hexed(own, BUCKET, PART + 1)} AS bucket FROM numbered)""",
        "raw AS (SELECT grp, crc, part, sum(size) AS weight, min(source) AS source, min(lang) AS lang, min(len) AS len FROM placed GROUP BY ALL)",
        "ranked AS (SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS d0, dense_rank() OVER (ORDER BY lang) - 1 AS d1, len AS d2 FROM raw)",
        f"""scaled AS MATERIALIZED (SELECT grp, crc, part, CAST(weight AS BIGINT) AS weight, CAST(1 AS BIGINT) AS node, {hexed("grp || ':' || part", TIE // 4)} AS tie,
          {', '.join(f'(d{i} - min(d{i}) OVER ()) * {(1 << VALUE) - 1} // greatest(1, max(d{i}) OVER () - min(d{i}) OVER ()) AS v{i}' for i in range(3))},
          (d2 - min(d2) OVER ()) * {(1 << LENGTH) - 1} // greatest(1, max(d2) OVER () - min(d2) OVER ()) AS span FROM ranked)""",
    ]
    now, count, level = "scaled", shards, 0
    while count > 1:
        widths = ", ".join(f"max(v{i}) - min(v{i}) AS w{i}" for i in range(3))
        ctes += [
            f"spread{level} AS (SELECT node, sum(weight) AS total, {widths} FROM {now} GROUP BY node)",
            f"""keyed{level} AS MATERIALIZED (SELECT u.*, total, (CASE WHEN w0 >= w1 AND w0 >= w2 THEN v0 WHEN w1 >= w2 THEN v1 ELSE v2 END) * {1 << (LENGTH + TIE)} + span * {1 << TIE} + tie AS key
              FROM {now} u JOIN spread{level} USING (node))""",
            f"""sums{level} AS (SELECT node, key, any_value(total) AS total, sum(weight) AS w, sum(sum(weight)) OVER (PARTITION BY node ORDER BY key) AS upto FROM keyed{level} GROUP BY node, key)""",
            f"""cut{level} AS (SELECT node, x.key - CASE WHEN 2 * (x.total * {count // 2} - (x.upto - x.w) * {count}) >= x.w * {count} THEN 0 ELSE 1 END AS cut
              FROM (SELECT node, arg_min(s, key) AS x FROM sums{level} s WHERE upto * {count} >= total * {count // 2} GROUP BY node))""",
            f"""units{level} AS MATERIALIZED (SELECT grp, crc, part, weight, tie, v0, v1, v2, span, 2 * node + CASE WHEN key <= cut THEN 0 ELSE 1 END AS node FROM keyed{level} JOIN cut{level} USING (node))""",
        ]
        now, count, level = f"units{level}", count // 2, level + 1
    return f"""WITH {', '.join(ctes)}
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(node - {shards} AS INTEGER) AS shard,
      row_number() OVER (PARTITION BY node ORDER BY bucket, doc_id NULLS FIRST, grp, crc, copy) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM placed JOIN {now} USING (grp, crc, part)"""
