"""Removal of repeated passages by suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it starts anywhere else.

1. Anchors. Every window of ``LENGTH`` bytes belongs to one anchor: the first of
   its ``GRAM``-byte strings with the smallest hash. Equal windows have equal
   anchors, so two equal strings meet under their anchor's hash.
2. Regions. The windows of an anchor make up one region around it. Regions that
   are equal as a whole are one kind; Spark counts kinds and fetches the bytes of
   one region of each that may repeat, so copies are never sorted in full.
3. Suffix arrays settle what repeats. A kind that occurs more than once goes in as
   two copies; kinds under one anchor go in together. Their texts, cut where any two
   begin to differ so that a block is one symbol, are concatenated and sorted by linear
   grouping; a suffix and its neighbour share a maximal match, and matches of
   ``LENGTH`` bytes are spans, which hold for every region of the kind.
4. Crowds. An anchor with more than ``CROWD`` kinds of region is split by the
   bytes next to it: windows that reach equally far to its left, within one of
   ``WIDTHS``, can only be equal if what all of them hold is equal. Stretches
   that are equal as a whole are one kind again, so the arrays of the third step
   settle them, with the next width where a group is too large still. At width 1 a
   stretch is a window, equal ones are one kind, and every group fits.

Defined results: a null or empty text has no bytes and keeps none; texts under
``LENGTH`` bytes are kept; each repeated row counts as a document; an empty table
gives an empty result; a long text is read as a whole by one task; other columns
are left alone.
"""

from __future__ import annotations

import struct
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Scratch, checkpoint, free, small_batches, text_of
from cairn.llm.gsaca import lcp_array, suffix_array

LENGTH, GRAM = 200, 32
#: Kinds of region that one group may hold; symbols that one suffix array is given, about.
CROWD, SYMBOLS = 1024, 1 << 15
#: Bytes to the anchor's left by which crowds are split, each a multiple of the next.
WIDTHS = (48, 8, 1)
CHUNK = 1 << 18
NONE = np.uint64((1 << 64) - 1)
KEY = ["doc", "hash"]


def _slide(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return of(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts laid end to end; ``bounds``: their ends."""
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seed = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    h, span = seed[data], 1
    parts = {1: h}
    while span * 2 <= gram:
        h = h[:-span] * np.uint64(0xBF58476D1CE4E5B9 + 2 * span) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
        parts[span] = h
    at, value = span, h
    for size in sorted(parts, reverse=True):  # gram need not be a power of two
        while at + size <= gram and size < span:
            value = value[: n - at - size + 1] * np.uint64(0x94D049BB133111EB) + parts[size][at : n - size + 1]
            at += size
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    for end in bounds[:-1]:  # no gram crosses two texts
        value[max(0, end - gram + 1) : end] = NONE
    low = _slide(value, length - gram + 1, np.minimum)
    w = length - gram
    best = _slide(np.concatenate([np.zeros(w, np.uint64), low, np.zeros(w, np.uint64)]), w + 1, np.maximum)
    found = np.flatnonzero((best == value) & (value != NONE))
    return found, value[found]


def reach(found: np.ndarray, fp: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """First and last start of the windows that belong to each anchor.

    A window that holds an earlier anchor with no larger hash, or a later one
    with a smaller hash, belongs to that one; where neighbours are larger, any
    smaller one is out of a window's reach.
    """
    first = np.maximum(found - (length - gram), starts[text])
    last = np.minimum(found, ends[text] - length)
    if len(found) > 1:
        near = text[1:] == text[:-1]
        a = near & (fp[:-1] <= fp[1:])
        first[1:][a] = np.maximum(first[1:][a], found[:-1][a] + 1)
        b = near & (fp[1:] < fp[:-1])
        last[:-1][b] = np.minimum(last[:-1][b], found[1:][b] - (length - gram + 1))
    return first, last


def _anchor_rows(length: int, gram: int):
    schema = pa.schema([("fp", pa.int64()), ("kind", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("left", pa.int16()), ("right", pa.int16())])
    digest = xxhash.xxh3_64_intdigest

    def chunk(docs: list[int], hashes: list[int], texts: list[bytes]):
        bounds = np.cumsum([len(x) for x in texts])
        whole = b"".join(texts)
        found, fp = anchors(np.frombuffer(whole, np.uint8), bounds, length, gram)
        text = np.searchsorted(bounds, found, side="right")
        starts = np.r_[0, bounds[:-1]]
        first, last = reach(found, fp, text, starts, bounds, length, gram)
        some = first <= last
        found, fp, text, first, last = (x[some] for x in (found, fp, text, first, last))
        at, left, right = found - starts[text], found - first, last + length - found
        # The kind is the region's bytes and where the anchor lies in it.
        kinds = [digest(whole[a:b], x) for a, b, x in zip((found - left).tolist(), (found + right).tolist(), left.tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(fp.view(np.int64)),
                pa.array(np.array(kinds, np.uint64).view(np.int64)),
                pa.array(np.array(docs, np.int64)[text]),
                pa.array(np.array(hashes, np.int64)[text]),
                pa.array(at.astype(np.int32)),
                pa.array(left.astype(np.int16)),
                pa.array(right.astype(np.int16)),
            ],
            schema=schema,
        )

    def run(batches):
        docs, hashes, texts, held = [], [], [], 0
        for b in batches:
            for doc, h, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if len(text) >= length:
                    docs.append(doc)
                    hashes.append(h)
                    texts.append(text)
                    held += len(text)
                    if held >= CHUNK:
                        yield chunk(docs, hashes, texts)
                        docs, hashes, texts, held = [], [], [], 0
        if texts:
            yield chunk(docs, hashes, texts)

    return run


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from the start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _best(rows: list[bytes]) -> tuple[list[int], set[int]]:
    """For every row the longest prefix that it shares with another; the lengths at which rows part."""
    order = sorted(range(len(rows)), key=rows.__getitem__)
    best, cuts = [0] * len(rows), set()
    for a, b in zip(order, order[1:]):
        n = _shared(rows[a], rows[b])
        cuts.add(n)
        best[a] = max(best[a], n)
        best[b] = max(best[b], n)
    return best, cuts


class Sorter:
    """Collects the blocks of many groups and sorts them as one text of symbols."""

    def __init__(self, length: int):
        self.length = length
        self.symbols: list[int] = []
        self.ids: dict[tuple, int] = {}
        self.owner: list[int] = []  # of each symbol: its row, -1 at separators
        self.edge: list[int] = []  # of each symbol: where it starts, relative to the anchor
        self.rows: list[tuple] = []
        self.groups = 0

    def add(self, group: list[tuple[tuple, bool, bytes, bytes]]) -> None:
        """(row, wanted, bytes before the anchor, bytes from the anchor on), at least two."""
        left, left_cuts = _best([x[2][::-1] for x in group])
        right, right_cuts = _best([x[3] for x in group])
        # Nearer cuts are no end of a match of ``length`` bytes.
        least_left, least_right = self.length - max(right), self.length - max(left)
        cuts = sorted({-c for c in left_cuts if c >= least_left} | {c for c in right_cuts if c >= least_right})
        self.groups += 1
        for (row, wanted, before, after), a, b in zip(group, left, right):
            if a + b < self.length:
                continue  # no window of it can occur in another row
            whole, zero = before + after, len(before)
            edges = [c for c in cuts if -a <= c <= b]
            own = len(self.rows)
            self.rows.append((row, wanted))
            for x, y in zip(edges, edges[1:]):
                block = (self.groups, x, y, whole[zero + x : zero + y])
                self.symbols.append(self.ids.setdefault(block, len(self.ids) + 2))
                self.owner.append(own)
                self.edge.append(x)
            self.symbols.append(1)  # separates rows and equals nothing
            self.owner.append(-1)
            self.edge.append(edges[-1])

    def matches(self):
        """(row, start, end): the union of a row's matches of ``length`` bytes or more.

        Each of them holds the anchor, so the union is one span, relative to it.
        """
        order = suffix_array(self.symbols)
        lcp = lcp_array(self.symbols, order, end=1)
        lcp.append(0)
        low, high = [1] * len(self.rows), [0] * len(self.rows)
        owner, edge, length = self.owner, self.edge, self.length
        for k, i in enumerate(order):
            a = edge[i]
            if a <= 0 and owner[i] >= 0:
                n = lcp[k] if lcp[k] > lcp[k + 1] else lcp[k + 1]
                b = edge[i + n]
                if b - a >= length:
                    own = owner[i]
                    low[own] = min(low[own], a)
                    high[own] = max(high[own], b)
        for (row, wanted), a, b in zip(self.rows, low, high):
            if wanted and b:
                yield row, a, b


SPAN = "fp long, kind long, lo int, hi int"


def _spans(found) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["fp", "kind", "lo", "hi"])


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)))


def _settle(sorter: Sorter) -> list[tuple]:
    return [(*row, a, b) for row, a, b in sorter.matches()]


def _sort_regions(length: int):
    """Rows (group, fp, kind, wanted, before, after), sorted by group, to spans."""

    def run(batches):
        sorter = Sorter(length)
        for _, group in groupby(_rows(batches), key=itemgetter(0)):
            sorter.add([((fp, kind), wanted, before, after) for _, fp, kind, wanted, before, after in group])
            if len(sorter.symbols) >= SYMBOLS:
                yield _spans(_settle(sorter))
                sorter = Sorter(length)
        yield _spans(_settle(sorter))

    return run


STRETCH = "fp long, kind long, before binary, after binary, low int, high int, first int, last int, inner binary, outer binary"


def _stretches(length: int, width: int):
    """A region's windows by the bytes they take left of the anchor, ``low`` to ``high``, in steps of ``width``.

    ``inner`` stands for the bytes that all windows of a step hold, ``outer``
    for those that any of the region's windows there holds (``first`` to
    ``last`` bytes to the left).
    """
    digest, pack = xxhash.xxh3_128_digest, struct.pack
    names = [x.split()[0] for x in STRETCH.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int32()] * 4, pa.binary(), pa.binary()]

    def run(batches):
        for b in batches:
            out = []
            for fp, kind, before, after, low, high in zip(*(b.column(k).to_pylist() for k in range(6))):
                whole, zero = before + after, len(before)
                least, most = max(low, length - len(after)), min(high, zero + 1)
                for x in range(low, most, width):
                    first, last = max(x, least), min(x + width, most) - 1
                    if first <= last:
                        inner = digest(pack("<qq", fp, x) + whole[zero - x : zero + max(0, length - x - width + 1)])
                        outer = digest(pack("<qq", first, last) + whole[zero - last : zero + length - first])
                        out.append((fp, kind, before, after, x, min(x + width, high), first, last, inner, outer))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


TWICE = "inner binary, outer binary, lo int, hi int"


def _sort_twice(length: int):
    """Stretches (inner, outer, before, after) that occur more than once, to their spans."""

    def settle(sorter: Sorter) -> pa.RecordBatch:
        found = _settle(sorter)
        columns = list(zip(*found)) if found else [()] * 4
        types = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["inner", "outer", "lo", "hi"])

    def run(batches):
        sorter = Sorter(length)
        for inner, outer, before, after in _rows(batches):
            sorter.add([((inner, outer), k == 0, before, after) for k in range(2)])
            if len(sorter.symbols) >= SYMBOLS:
                yield settle(sorter)
                sorter = Sorter(length)
        yield settle(sorter)

    return run


def _split_crowds(crowded: DataFrame, width: int, length: int, crowd: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The spans found at this width, and the rows of groups that are crowded still."""
    region, key = ["fp", "kind", "before", "after", "low", "high"], ["inner", "outer"]
    steps = scratch.keep(f"steps{width}", crowded.select(*region).mapInArrow(_stretches(length, width), STRETCH))
    # One stretch of each kind is left to be held against the others.
    one = F.min(F.struct(*region, "first", "last")).alias("one")
    kinds = scratch.keep(f"kinds{width}", steps.groupBy(*key).agg(F.count("*").alias("n"), one))
    twice = kinds.filter("n > 1").select(
        *key, F.expr("substring(one.before, length(one.before) - one.last + 1, one.last)").alias("before"),
        F.expr(f"substring(one.after, 1, {length} - one.first)").alias("after"),
    )
    twice = scratch.keep(f"twice{width}", twice.mapInArrow(_sort_twice(length), TWICE))
    equal = steps.select("fp", "kind", *key).join(twice, key).select("fp", "kind", "lo", "hi")
    size = scratch.keep(f"sizes{width}", kinds.groupBy("inner").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    unlike = scratch.keep(f"unlike{width}", kinds.join(size, "inner").select("inner", "kinds", "n", "one.*"))
    sortable = unlike.filter(F.col("kinds") <= crowd).select("inner", "fp", "kind", (F.col("n") == 1).alias("wanted"), "before", "after")
    ordered = sortable.repartition("inner").sortWithinPartitions("inner").mapInArrow(_sort_regions(length), SPAN)
    return [equal, scratch.keep(f"sorted{width}", ordered)], unlike.filter(F.col("kinds") > crowd).select(*region)


REGION = "fp long, kind long, wanted boolean, before binary, after binary, crowded boolean, lo int, hi int"


def _fetch(length: int):
    """Cuts the regions asked for out of the texts; kinds that occur more than once are settled at once."""
    names = [x.split()[0] for x in REGION.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches):
        sorter = Sorter(length)
        for b in batches:
            out = []
            for data, asks in zip(*(b.column(k).to_pylist() for k in range(2))):
                for x in asks:
                    before, after = data[x["at"] - x["left"] : x["at"]], data[x["at"] : x["at"] + x["right"]]
                    if x["n"] > 1:
                        sorter.add([((x["fp"], x["kind"]), k == 0, before, after) for k in range(2)])
                    if x["kinds"] > 1:
                        out.append((x["fp"], x["kind"], x["n"] == 1, before, after, x["crowded"], None, None))
                if len(sorter.symbols) >= SYMBOLS:
                    out += [(fp, kind, False, None, None, None, lo, hi) for fp, kind, lo, hi in _settle(sorter)]
                    sorter = Sorter(length)
            yield batch(out)
        yield batch([(fp, kind, False, None, None, None, lo, hi) for fp, kind, lo, hi in _settle(sorter)])

    return run


def find_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``(doc, hash, spans)``: byte ranges to remove, as (lo, hi), unsorted and overlapping."""
    small_batches(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text_of()).alias("hash"),
        text_of().cast("binary").alias("data"),
    )
    schema = "fp long, kind long, doc long, hash long, at int, left short, right short"
    long = keyed.filter(F.octet_length("data") >= length).select("doc", "hash", "data")
    points = scratch.keep("anchors", long.mapInArrow(_anchor_rows(length, gram), schema))
    # Counts are kept before they are joined, so a join of a hot anchor can be split.
    often = scratch.keep("often", points.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    points = scratch.keep("meeting", points.join(often, "fp"))
    scratch.drop("anchors")
    first = F.min(F.struct("doc", "hash", "at", "left", "right")).alias("first")
    kinds = scratch.keep("kinds", points.groupBy("fp", "kind").agg(F.count("*").alias("n"), first))
    size = scratch.keep("sizes", kinds.groupBy("fp").agg(F.count("*").alias("kinds")))
    ask = F.struct("fp", "kind", "n", "kinds", "first.at", "first.left", "first.right", (F.col("kinds") > crowd).alias("crowded")).alias("ask")
    asked = kinds.join(size, "fp").select("first.doc", "first.hash", ask).groupBy(*KEY).agg(F.collect_list("ask").alias("asks"))
    # Rows that agree in id and text are asked once.
    fetched = long.dropDuplicates(KEY).join(asked, KEY).select("data", "asks")
    regions = scratch.keep("regions", fetched.mapInArrow(_fetch(length), REGION))
    sortable = regions.filter("not crowded").select(F.col("fp").alias("group"), "fp", "kind", "wanted", "before", "after")
    ordered = sortable.repartition("group").sortWithinPartitions("group").mapInArrow(_sort_regions(length), SPAN)
    parts = [regions.filter("lo is not null").select("fp", "kind", "lo", "hi"), scratch.keep("sorted", ordered)]
    crowded = regions.filter("crowded").withColumns({"low": F.lit(0), "high": F.lit(length - gram + 1)})
    for width in WIDTHS:
        if not crowded.head(1):
            break
        found, crowded = _split_crowds(crowded, width, length, crowd, scratch)
        parts += found
    spans = reduce(DataFrame.unionByName, parts)
    # What holds for a kind holds for each of its regions.
    placed = points.join(scratch.keep("spans", spans), ["fp", "kind"]).select(
        *KEY, (F.col("at") + F.col("lo")).cast("int").alias("lo"), (F.col("at") + F.col("hi")).cast("int").alias("hi")
    )
    out = checkpoint(placed.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    free(docs.sparkSession)
    return out


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint and not adjacent."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


CUT = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    merged = [merge(s) for s in spans.to_pylist()]
    kept = [keep((t or "").encode("utf-8", "surrogatepass"), s) for t, s in zip(texts.to_pylist(), merged)]
    pair = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    listed = pa.array([[{"lo": a, "hi": b} for a, b in s] for s in merged], pa.list_(pair))
    return pa.StructArray.from_arrays([listed, pa.array(kept, pa.binary())], ["spans", "kept"])


def _joined(docs: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        spans = find_spans(docs.select("doc_id", "text"), scratch, length, gram, crowd)
    spans = spans.select(F.col("doc").alias("__sd_doc"), F.col("hash").alias("__sd_hash"), F.col("spans").alias("__sd_spans"))
    keyed = docs.withColumns(
        {"__sd_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__sd_hash": F.xxhash64(text_of())}
    )
    return keyed.join(spans, ["__sd_doc", "__sd_hash"], "left").withColumn("__sd_cut", F.arrow_udf(_cut, CUT)(text_of(), F.col("__sd_spans")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, n_bytes``, the merged ``spans`` removed and the ``kept`` bytes."""
    joined = _joined(docs.select("doc_id", "text"), length, gram, crowd)
    return joined.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "__sd_cut.spans", "__sd_cut.kept")


def cut_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its texts; a character that is cut into goes with them."""
    joined = _joined(docs, LENGTH, GRAM, CROWD)

    def decode(kept: pa.Array) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())

    text = F.when(F.col("__sd_spans").isNull(), F.col("text")).otherwise(F.arrow_udf(decode, T.StringType())("__sd_cut.kept"))
    return joined.select(*(text.alias("text") if c == "text" else joined[c] for c in docs.columns))


def oracle(length: int = LENGTH) -> str:
    """The same in SQL: every string of ``length`` bytes by its hash, then the runs that they cover."""
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS MATERIALIZED (
      SELECT r, i, hash(b[i + 1:i + {length}]) AS h
      FROM (SELECT r, b, unnest(range(octet_length(b) - {length - 1})) AS i FROM d WHERE octet_length(b) >= {length})),
    s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    o AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
      FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM s)),
    runs AS (SELECT r, min(i) AS lo, max(i) + {length} AS hi FROM o GROUP BY r, run),
    gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM runs),
    k AS (
      SELECT r, string_agg(hex(b[prev + 1:lo]), '' ORDER BY lo) AS kept, max(hi) AS last, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans
      FROM gaps JOIN d USING (r) GROUP BY r)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256
    FROM d LEFT JOIN k USING (r)"""
