"""Content identifiers as Spark columns: ``b`` + base32(version, codec, hash type, length, digest)."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the identifier's header.
VERSION, RAW, DAG_CBOR, BLAKE3, DIGEST_BYTES = 0x01, 0x55, 0x71, 0x1E, 32
BASE32, BASE32HEX = "abcdefghijklmnopqrstuvwxyz234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def is_digest(hex_digest: Column) -> Column:
    return F.coalesce(hex_digest.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def cid_of_digest(hex_digest: Column, codec: int = RAW) -> Column:
    """The identifier of a 32-byte digest in hex; null unless it is one."""
    head = f"{VERSION:02x}{codec:02x}{BLAKE3:02x}{DIGEST_BYTES:02x}"
    # 36 bytes padded to 40: eight groups of 40 bits, eight letters each.
    padded = F.concat(F.lit(head), hex_digest, F.lit("0" * 8))
    groups = [F.lpad(F.conv(F.substring(padded, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(8)]
    body = F.translate(F.substring(F.concat(*groups), 1, 58), BASE32HEX, BASE32)
    return F.when(is_digest(hex_digest), F.concat(F.lit("b"), body))


def cid_of_bytes(digest: Column, codec: int = RAW) -> Column:
    return cid_of_digest(F.lower(F.hex(digest)), codec)


def _hex(cid: Column) -> Column:
    body = F.rpad(F.translate(F.lower(F.substring(cid, 2, 58)), BASE32, BASE32HEX), 64, "0")
    groups = [F.lpad(F.conv(F.substring(body, 8 * i + 1, 8), 32, 16), 10, "0") for i in range(8)]
    return F.lower(F.substring(F.concat(*groups), 1, 72))


def cid_is_valid(cid: Column) -> Column:
    """Lenient: the prefix, two characters, and base32 letters of either case."""
    return F.coalesce(cid.rlike("^b[a-zA-Z2-7]+$"), F.lit(False))


def cid_is_canonical(cid: Column) -> Column:
    """Strict: raw or object codec, this hash, a whole digest, lower case."""
    return F.coalesce(cid.rlike("^ba(fk|fy)r4i[a-z2-7]{52}$"), F.lit(False))


def cid_decode(cid: Column) -> Column:
    """``struct(version, codec, hash_type, hash)`` of a 59-character identifier, else null.

    The header's four numbers take a byte each; ``cid_decode_any`` reads any header.
    """

    def parts(text: Column) -> Column:
        byte = lambda i: F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("long")
        return F.struct(
            byte(0).alias("version"), byte(1).alias("codec"), byte(2).alias("hash_type"), F.substring(text, 9, 64).alias("hash")
        )

    # Bound by a lambda, the digits are worked out once, not once a field.
    return F.when(cid_is_valid(cid) & (F.length(cid) == 59), F.transform(F.array(_hex(cid)), parts)[0])


PARTS = T.StructType([T.StructField(k, T.LongType()) for k in ("version", "codec", "hash_type")] + [T.StructField("hash", T.StringType())])


def cid_decode_any(cid: Column) -> Column:
    """The parts of an identifier with any header; null where ``decode`` fails."""

    def one(text: str | None) -> dict | None:
        try:
            return None if text is None else decode(text)
        except ValueError:
            return None

    kind = pa.struct([(f.name, pa.string() if f.name == "hash" else pa.int64()) for f in PARTS])
    return F.arrow_udf(lambda col: pa.array(map(one, col.to_pylist()), kind), PARTS)(cid)


def encode(digest: bytes, codec: int = RAW, hash_type: int = BLAKE3) -> str:
    """The identifier of a digest, header and all, as Python text."""
    data = b"".join(map(varint, (VERSION, codec, hash_type, len(digest)))) + digest
    return "b" + base64.b32encode(data).decode().lower().rstrip("=")


def decode(text: str) -> dict:
    """Parts of an identifier: letters of either case; a digest that is cut short is filled with zeros.

    ``ValueError`` for a missing prefix, other letters or a header that ends early.
    """
    if len(text) < 2 or text[0] != "b":
        raise ValueError(f"not an identifier: {text!r}")
    body = text[1:].upper()
    # Lengths that no whole number of bytes gives lose their last letter.
    body = body[: len(body) - (len(body) % 8 in (1, 3, 6))]
    data, at, parts = base64.b32decode(body + "=" * (-len(body) % 8)), 0, []
    for _ in range(4):
        try:
            value, at = read_varint(data, at)
        except EOFError as e:
            raise ValueError(f"not an identifier: {text!r}") from e
        parts.append(value)
    size = min(parts[3], 1 << 16)
    digest = data[at : at + size].ljust(size, b"\0")
    return {"version": parts[0], "codec": parts[1], "hash_type": parts[2], "hash": digest.hex()}


def varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position after it); ``EOFError`` if the bytes end first."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("varint is cut short")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value, at
