"""Packing token ids into sequences: first-fit decreasing over a tournament tree.

Documents are dealt into random groups by a hash; every group is packed on its
own. A document's full windows are sequences of their own; what remains of it
goes, longest first, to the leftmost open sequence with room, found by walking
down a tournament tree whose nodes hold the largest room below them. Then the
fullest sequences are topped up with cuts from the emptiest, and the one
sequence left open is cut at powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; every row is a
document of its own, so repeated rows are packed repeatedly; an empty table
gives an empty result; other columns are never read. Rows that agree in both
id and text fall in one group.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches, text_of, worker_cache

CAPACITY, END = 4096, 2
#: Documents in a group on average; one group is held by one task at a time.
GROUP = 2048
REMEMBERED = 400_000

#: Characters for which the split below equals the tokenizer's own; other texts go to it whole.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ]")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"


class Words(dict):
    """Split word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, by words it has seen before.

    ``split`` is the tokenizer's own word pattern over ``PLAIN`` characters; it
    drops white space and splits lower-cased text, so words encode alone.
    """

    def __init__(self, data: bytes):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.words = Words(self.tokenizer)
        spec = json.loads(data)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        patterns = re.findall(r'"Regex":\s*"((?:[^"\\]|\\.)*)"', json.dumps(spec["pre_tokenizer"]))
        pattern = json.loads(f'"{patterns[0]}"')
        pattern = pattern.replace(r"\p{L}", LETTER).replace(r"\p{N}", NUMBER)
        self.split = re.compile(pattern).findall

    def ids(self, text: str) -> bytes:
        if PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))


def encoder(data: bytes) -> Encoder:
    cache, key = worker_cache(), f"words {hashlib.sha1(data).hexdigest()}"
    if key not in cache:
        cache[key] = Encoder(data)
    return cache[key]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every size, sizes taken longest first (ties in the order given)."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item] = node - leaves
        room[node] -= need
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            room[node] = a if a > b else b
    return bins


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, k in zip(rest, first_fit_decreasing([x[2] for x in rest], capacity)):
        bins.setdefault(k, []).append(item)
    held = sorted(bins.values(), key=lambda b: -sum(x[2] for x in b))
    used = [sum(x[2] for x in b) for b in held]
    low, high = 0, len(held) - 1
    while low < high:
        gap = capacity - used[low]
        if not gap:
            low += 1
            continue
        doc, start, n = held[high].pop()
        take = min(gap, n)
        if n > take:
            held[high].append((doc, start, n - take))
        held[low].append((doc, start + n - take, take))
        used[low] += take
        used[high] -= take
        if not used[high]:
            high -= 1
    for k, items in enumerate(held):
        if not used[k]:
            continue
        # Full, or the last one: cut at powers of two.
        left = [1 << b for b in range(capacity.bit_length()) if used[k] >> b & 1] if used[k] < capacity else [capacity]
        size, offset = left.pop(), 0
        for doc, start, n in items:
            while n:
                take = min(n, size - offset)
                pieces.append((doc, start, take, sequences, offset))
                start, n, offset = start + take, n - take, offset + take
                if offset == size:
                    sequences += 1
                    size, offset = (left.pop() if left else 0), 0
    return pieces


PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END, group: int = GROUP) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit) and its place."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokens(texts: pa.Array) -> pa.Array:
        of = encoder(tokenizer.value).ids
        return pa.array([of(x or "") + end for x in texts.to_pylist()], pa.binary())

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        ids = table.column("ids").to_pylist()
        names = table.column("doc_id").to_pylist()
        base = (table.column("group")[0].as_py() if len(ids) else 0) << 32
        out = pack_group([len(x) // 4 for x in ids], capacity)
        return pa.table(
            [
                pa.array([names[p[0]] for p in out], pa.int64()),
                pa.array([p[1] for p in out], pa.int64()),
                pa.array([p[2] for p in out], pa.int64()),
                pa.array([len(ids[p[0]]) // 4 for p in out], pa.int64()),
                pa.array([base + p[3] for p in out], pa.int64()),
                pa.array([p[4] for p in out], pa.int64()),
                pa.array([ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in out], pa.binary()),
            ],
            names=PIECE.names,
        )

    groups = max(1, -(-docs.count() // group))
    hashed = F.xxhash64(text_of())
    return (
        docs.select(F.col("doc_id").cast("long"), hashed.alias("text_hash"), F.arrow_udf(tokens, T.BinaryType())(text_of()).alias("ids"))
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(one, PIECE)
    )
