"""Byte-level BPE with a segment tree of pair ranks.

Each match of the split pattern is encoded on its own. Leaf ``i`` of the tree
holds the rank of the pair that starts at live byte position ``i``; inner nodes
hold the smallest (rank, position), so the root is the leftmost best pair. A
merge writes two leaves and clears one, each in logarithmic time, so a match of
n bytes takes O(n log n), however long.

Defined results: a null or empty text has no ids; its digests are those of the
empty string. Rows are independent: repeated rows repeat the result, an empty
table gives an empty result, and other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches, text_of, worker_cache

#: Distinct matches whose ids a Python worker remembers.
REMEMBERED = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the whole match if it is a token, else merges by rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    never = 1 << 62
    tree = [never] * (2 * size)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value

    def pair(i: int) -> int:
        j = after[i]
        rank = get(part[i] + part[j]) if j < n else None
        return never if rank is None else rank << shift | i

    low = (1 << shift) - 1
    while tree[1] < never:
        i = tree[1] & low
        j = after[i]
        part[i] += part[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, never)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[part[i]])
        i = after[i]
    return ids


class Pieces(dict):
    """Match -> (number of ids, ids in decimal joined by commas, decoded bytes)."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
        found = len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


def codec(data: bytes, pattern: str) -> tuple[Pieces, regex.Pattern]:
    cache, key = worker_cache(), f"bpe {hashlib.sha1(data).hexdigest()} {pattern}"
    if key not in cache:
        cache[key] = Pieces(read_ranks(data)), regex.compile(pattern)
    return cache[key]


RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, the number of ids, the ids joined by commas and the bytes they decode to."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(texts: pa.Array) -> pa.Array:
        pieces, split = codec(ranks.value, pattern)
        one = pieces.__getitem__
        counts, ids, decoded = [], [], []
        for text in texts.to_pylist():
            found = list(map(one, split.findall(text or "")))
            counts.append(sum([x[0] for x in found]))
            ids.append(",".join([x[1] for x in found]))
            decoded.append(b"".join([x[2] for x in found]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())],
            ["n_tokens", "ids", "decoded"],
        )

    of = F.arrow_udf(run, RESULT)
    return docs.select("doc_id", of(text_of()).alias("r")).select("doc_id", "r.n_tokens", "r.ids", "r.decoded")
