"""BLAKE3 and its verification tree, vectorised over all chunks of an Arrow batch."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.cbor import encode
from cairn.functions.cid import DAG_CBOR, RAW, cid_of_digest

#: Fixed values of the published specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK, BLOCK = 1024, 64
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: Chunks that are hashed at once.
WAVE = 1 << 13


def _turn(x: np.ndarray, n: int) -> None:
    """Rotates to the right in place."""
    low = x >> np.uint32(n)
    x <<= np.uint32(32 - n)
    x |= low


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values; all arguments are columns: (8, n), (16, n), (n,), (n,), (n,)."""
    n = cv.shape[1]
    a, b = cv[:4].copy(), cv[4:].copy()
    c = np.repeat(np.array(IV[:4], np.uint32)[:, None], n, axis=1)
    d = np.empty((4, n), np.uint32)
    d[0], d[1], d[2], d[3] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    order = np.arange(16)
    for _ in range(7):
        for first in (0, 8):
            for at, p, q in ((0, 16, 12), (1, 8, 7)):
                a += b
                a += m[order[first + at : first + 8 : 2]]
                d ^= a
                _turn(d, p)
                c += d
                b ^= c
                _turn(b, q)
            # The second half of a round works on diagonals.
            s = -1 if first == 0 else 1
            b, c, d = np.roll(b, s, 0), np.roll(c, 2, 0), np.roll(d, -s, 0)
        order = order[PERMUTATION]
    return np.concatenate([a ^ c, b ^ d])


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of all chunks, (n, 8), and the number of chunks of each text."""
    counts = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
    data = np.zeros((counts.sum(), CHUNK), np.uint8)
    sizes = np.full(len(data), CHUNK)
    last = np.cumsum(counts) - 1
    at = 0
    for t, c in zip(texts, counts):
        data[at : at + c].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += c
    sizes[last] = [len(t) - (c - 1) * CHUNK for t, c in zip(texts, counts)]
    counter = np.arange(len(data), dtype=np.uint64) - np.repeat(last + 1 - counts, counts).astype(np.uint64)
    single = np.repeat(counts == 1, counts)
    out = np.empty((len(data), 8), np.uint32)
    for s in range(0, len(data), WAVE):
        part = slice(s, s + WAVE)
        words = data[part].view("<u4").reshape(-1, 16, 16)
        size = sizes[part]
        blocks = np.maximum(1, -(-size // BLOCK))
        cv = np.repeat(np.array(IV, np.uint32)[:, None], len(size), axis=1)
        for k in range(int(blocks.max(initial=1))):
            on = np.flatnonzero(blocks > k)
            end = blocks[on] == k + 1
            flags = (CHUNK_START * (k == 0) + CHUNK_END * end + ROOT * (end & single[part][on])).astype(np.uint32)
            length = np.minimum(BLOCK, size[on] - k * BLOCK).astype(np.uint32)
            cv[:, on] = _compress(cv[:, on], words[on, k].T.astype(np.uint32), counter[part][on], length, flags)
        out[part] = cv.T
    return out, counts


def _parents(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    n = len(pairs)
    key = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
    flags = (PARENT + ROOT * root).astype(np.uint32)
    return _compress(key, pairs.reshape(n, 16).T, np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), flags).T


def hash_all(texts: list[bytes], outboards: bool = False) -> list[tuple[bytes, bytes | None]]:
    """(digest, outboard) of every text; levels of all trees are merged together."""
    if not texts:
        return []
    values, counts = _chunks(texts)
    ends = np.cumsum(counts)
    levels = [values[e - c : e] for e, c in zip(ends, counts)]
    trees: list[list[np.ndarray]] = [[x] for x in levels]
    while True:
        busy = [k for k, x in enumerate(levels) if len(x) > 1]
        if not busy:
            break
        pairs = np.concatenate([levels[k][: len(levels[k]) // 2 * 2].reshape(-1, 16) for k in busy])
        root = np.concatenate([np.full(len(levels[k]) // 2, len(levels[k]) == 2) for k in busy])
        merged, at = _parents(pairs, root), 0
        for k in busy:
            half = len(levels[k]) // 2
            rest = levels[k][2 * half :]  # an odd one out moves up as it is
            levels[k] = np.concatenate([merged[at : at + half], rest])
            trees[k].append(levels[k])
            at += half
    out = []
    for text, tree in zip(texts, trees):
        board = None
        if outboards:
            nodes: list[bytes] = []

            def visit(level: int, i: int, tree=tree, nodes=nodes) -> None:
                if not level:
                    return
                below = tree[level - 1]
                if 2 * i + 1 < len(below):
                    nodes.append(below[2 * i : 2 * i + 2].astype("<u4").tobytes())
                    visit(level - 1, 2 * i)
                    visit(level - 1, 2 * i + 1)
                else:
                    visit(level - 1, 2 * i)

            visit(len(tree) - 1, 0)
            board = len(text).to_bytes(8, "little") + b"".join(nodes)
        out.append((tree[-1][0].astype("<u4").tobytes(), board))
    return out


def digest(data: bytes) -> bytes:
    return hash_all([data])[0][0]


def _digests(col: pa.Array) -> pa.Array:
    values = col.to_pylist()
    found = iter(hash_all([x for x in values if x is not None]))
    return pa.array([None if x is None else next(found)[0].hex() for x in values], pa.string())


RESULT = T.StructType([T.StructField("hash", T.StringType()), T.StructField("outboard", T.BinaryType()), T.StructField("size", T.LongType())])


def _results(col: pa.Array) -> pa.Array:
    values = col.to_pylist()
    found = iter(hash_all([x for x in values if x is not None], outboards=True))
    rows = [None if x is None else (*next(found), len(x)) for x in values]
    kind = pa.struct([("hash", pa.string()), ("outboard", pa.binary()), ("size", pa.int64())])
    return pa.array([r and {"hash": r[0].hex(), "outboard": r[1], "size": r[2]} for r in rows], kind)


def blake3(content: Column) -> Column:
    """64 hex digits of a binary column."""
    return F.arrow_udf(_digests, T.StringType())(content)


def hash_result(content: Column) -> Column:
    """``struct(hash, outboard, size)`` of a binary column."""
    return F.arrow_udf(_results, RESULT)(content)


def blob_cid(content: Column) -> Column:
    return cid_of_digest(blake3(content), RAW)


def object_cid(encoded: Column) -> Column:
    return cid_of_digest(blake3(encoded), DAG_CBOR)


CODED = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("hash", T.StringType())])


def coded_objects(text: Column) -> Column:
    """``struct(bytes, hash)`` of objects given as JSON: canonical bytes and their digest, in one pass."""

    def run(col: pa.Array) -> pa.Array:
        coded = pa.array([None if x is None else encode(json.loads(x)) for x in col.to_pylist()], pa.binary())
        return pa.StructArray.from_arrays([coded, _digests(coded)], ["bytes", "hash"])

    return F.arrow_udf(run, CODED)(text)
