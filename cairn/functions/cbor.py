"""Canonical binary objects: CBOR with definite lengths, shortest integers and sorted map keys.

Floating numbers and unknown types become text, in Java's notation for numbers;
a link is a map with the single key ``/``. Keys sort by length, then bytes, in
``key_order`` alone.
"""

from __future__ import annotations

import json
import math
import struct
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_order(key: str) -> tuple[int, bytes]:
    data = key.encode()
    return len(data), data


def float_text(x: float) -> str:
    """A double as Java writes it."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        text = f"{x:.17g}" if "e" in repr(x) else repr(x)
        return text if "." in text else f"{text}.0"
    mantissa, _, exponent = f"{x!r}".partition("e") if "e" in repr(x) else (None, None, None)
    if mantissa is None:
        digits = repr(x).lstrip("-").replace(".", "")
        power = math.floor(math.log10(abs(x)))
        digits = digits.strip("0") or "0"
        mantissa = ("-" if x < 0 else "") + digits[0] + "." + (digits[1:] or "0")
        return f"{mantissa}E{power}"
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for code, form, most in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < most:
            return bytes([kind << 5 | code]) + struct.pack(form, n)
    raise OverflowError(n)


#: Keys seen before, up to ``KEYS_HELD``: their place in the order and their bytes.
KEYS: dict[str, tuple[tuple[int, bytes], bytes]] = {}
KEYS_HELD = 4096


def _key(key: str) -> tuple[tuple[int, bytes], bytes]:
    found = KEYS.get(key)
    if found is None:
        found = key_order(key), encode(key)
        if len(KEYS) < KEYS_HELD:
            KEYS[key] = found
    return found


def encode(value) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, dict):
        items = sorted(((*_key(str(k)), v) for k, v in value.items()), key=itemgetter(0))
        return _head(5, len(items)) + b"".join(k + encode(v) for _, k, v in items)
    if isinstance(value, list):
        return _head(4, len(value)) + b"".join(map(encode, value))
    data = (float_text(value) if isinstance(value, float) else str(value)).encode()
    return _head(3, len(data)) + data


def _read(data: bytes, at: int):
    kind, n = data[at] >> 5, data[at] & 31
    at += 1
    if kind == 7:
        return {20: False, 21: True}.get(n), at + {24: 1, 25: 2, 26: 4, 27: 8}.get(n, 0)
    if n >= 24:
        size = 1 << (n - 24)
        n = int.from_bytes(data[at : at + size], "big")
        at += size
    if kind < 2:
        return (n if kind == 0 else -1 - n), at
    if kind in (2, 3):
        if at + n > len(data):
            raise EOFError("object is cut short")
        part = data[at : at + n]
        return (part if kind == 2 else part.decode()), at + n
    if kind == 4:
        out = []
        for _ in range(n):
            value, at = _read(data, at)
            out.append(value)
        return out, at
    if kind == 5:
        found = {}
        for _ in range(n):
            key, at = _read(data, at)
            found[key], at = _read(data, at)
        return found, at
    _, at = _read(data, at)  # tagged values are not part of the format
    return None, at


def decode(data: bytes):
    return _read(data, 0)[0]


def normalise(value):
    """Metadata in its plain form: text keys, no nulls, lists and maps all the way down."""
    if isinstance(value, dict):
        return {str(k): normalise(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [normalise(v) for v in value if v is not None]
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    return str(value)


def _each(f, kind):
    return lambda col: pa.array([None if x is None else f(x) for x in col.to_pylist()], kind)


def encode_json(text: Column) -> Column:
    """Canonical bytes of an object given as JSON."""
    return F.arrow_udf(_each(lambda x: encode(json.loads(x)), pa.binary()), T.BinaryType())(text)


def decode_json(data: Column) -> Column:
    """The object of canonical bytes as JSON; byte strings as hex."""
    dump = lambda x: json.dumps(decode(x), ensure_ascii=False, separators=(",", ":"), default=lambda b: b.hex())
    return F.arrow_udf(_each(dump, pa.string()), T.StringType())(data)


def normalise_json(text: Column) -> Column:
    dump = lambda x: json.dumps(normalise(json.loads(x)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return F.arrow_udf(_each(dump, pa.string()), T.StringType())(text)
