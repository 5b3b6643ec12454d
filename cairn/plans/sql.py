"""SQL that DuckDB runs beside the queries: identifiers, canonical bytes and BLAKE3, from the published formats.

Bytes are strings of hex digits throughout.
"""

from __future__ import annotations

from cairn.functions.blake3 import CHUNK, IV, PERMUTATION
from cairn.functions.cid import BASE32


def cid_text(hexed: str, codec: str = "55") -> str:
    """The identifier of a digest: groups of ten hex digits, eight letters each."""
    padded = f"('01{codec}1e20' || {hexed} || '00000000')"
    letters = (
        f"substr('{BASE32}', CAST(1 + ((CAST('0x' || substr({padded}, {10 * (i // 8) + 1}, 10) AS UBIGINT) >> {35 - 5 * (i % 8)}) & 31) AS BIGINT), 1)" for i in range(58)
    )
    return f"('b' || {' || '.join(letters)})"


def bytes_of(text: str) -> str:
    return f"lower(hex(encode({text})))"


def head(kind: int, n: str) -> str:
    """The first bytes of a canonical value, lengths and integers up to 32 bits."""
    cases = [(24, 0, 2), (1 << 8, 24, 2), (1 << 16, 25, 4), (1 << 32, 26, 8)]
    parts = [f"WHEN {n} < 24 THEN printf('%02x', CAST({kind << 5} + {n} AS BIGINT))"]
    parts += [f"WHEN {n} < {most} THEN '{kind << 5 | code:02x}' || printf('%0{width}x', CAST({n} AS BIGINT))" for most, code, width in cases[1:]]
    return f"(CASE {' '.join(parts)} END)"


def text(value: str) -> str:
    """A canonical text; null is the null value."""
    return f"coalesce({head(3, f'octet_length(encode({value}))')} || {bytes_of(value)}, 'f6')"


def integer(value: str) -> str:
    return f"coalesce({head(0, value)}, 'f6')"


def link(cid: str) -> str:
    return f"('a1' || {text(chr(39) + '/' + chr(39))} || {text(cid)})"


def mapping(entries: dict[str, str], optional: dict[str, str] | None = None) -> str:
    """A canonical map; ``optional`` entries are left out where they are null."""
    every = {**entries, **(optional or {})}
    some = "".join(f" + CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v in (optional or {}).values())
    body = " || ".join(
        f"coalesce({text(chr(39) + k + chr(39))} || {every[k]}, '')" for k in sorted(every, key=lambda k: (len(k.encode()), k.encode()))
    )
    return f"({head(5, f'({len(entries)}{some})')} || {body})"


def _swap(word: str) -> str:
    """A 32-bit number as its four bytes, lowest first."""
    return " || ".join(f"printf('%02x', CAST(({word} >> {8 * k}) & 255 AS BIGINT))" for k in range(4))


def _compress(source: str, keep: str) -> str:
    """``source`` (h0-h7, m0-m15, lo, len, flags) with r0 to r7, the new chaining value.

    Every step is a query over the one before, so no expression is written twice.
    """
    state = [f"h{i}" for i in range(8)] + [str(x) for x in IV[:4]] + ["lo", "0", "len", "flags"]
    words = [f"m{i}" for i in range(16)]
    sql = f"SELECT {keep}, {', '.join(words)}, {', '.join(f'CAST({x} AS UBIGINT) AS v{i}' for i, x in enumerate(state))} FROM ({source})"
    order = list(range(16))

    def turn(x: str, n: int) -> str:
        return f"((({x}) >> {n}) | ((({x}) << {32 - n}) & 4294967295))"

    def step(sql: str, new: dict[int, str]) -> str:
        rest = ", ".join(f"{new[i]} AS v{i}" if i in new else f"v{i}" for i in range(16))
        return f"SELECT {keep}, {', '.join(words)}, {rest} FROM ({sql})"

    for r in range(7):
        for shift, base in ((0, 0), (1, 8)):
            quads = [(k, 4 + (k + shift) % 4, 8 + (k + 2 * shift) % 4, 12 + (k + 3 * shift) % 4) for k in range(4)]
            for half, (p, q) in enumerate(((16, 12), (8, 7))):
                m = [f"m{order[base + 2 * k + half]}" for k in range(4)]
                sql = step(sql, {a: f"(v{a} + v{b} + {m[k]}) & 4294967295" for k, (a, b, c, d) in enumerate(quads)})
                sql = step(sql, {d: turn(f"xor(v{d}, v{a})", p) for a, b, c, d in quads})
                sql = step(sql, {c: f"(v{c} + v{d}) & 4294967295" for a, b, c, d in quads})
                sql = step(sql, {b: turn(f"xor(v{b}, v{c})", q) for a, b, c, d in quads})
        order = [order[p] for p in PERMUTATION]
    return f"SELECT {keep}, {', '.join(f'xor(v{i}, v{i + 8}) AS r{i}' for i in range(8))} FROM ({sql})"


def blake3(source: str, outboard: bool = False) -> str:
    """``id, hash`` (and ``outboard``) of ``source(id, hx)``."""
    cv = [f"h{i}" for i in range(8)]
    listed = ", ".join(cv)
    iv = ", ".join(f"CAST({x} AS UBIGINT) AS h{i}" for i, x in enumerate(IV))
    byte = lambda i, j: f"CAST('0x' || substr(bx, {8 * i + 2 * j + 1}, 2) AS UBIGINT)"
    words = ", ".join(f"{byte(i, 0)} + ({byte(i, 1)} << 8) + ({byte(i, 2)} << 16) + ({byte(i, 3)} << 24) AS m{i}" for i in range(16))
    blocks = f"""SELECT id, c, n, k, blocks, chx, {listed}, c AS lo, size AS len, {words},
      CASE WHEN k = 0 THEN 1 ELSE 0 END + CASE WHEN k + 1 = blocks THEN 2 ELSE 0 END + CASE WHEN k + 1 = blocks AND n = 1 THEN 8 ELSE 0 END AS flags
      FROM (SELECT *, least(64, length(chx) // 2 - 64 * k) AS size, rpad(substr(chx, 128 * k + 1, 128), 128, '0') AS bx FROM chunks WHERE k < blocks)"""
    parents = f"""SELECT id, level + 1 AS level, c // 2 AS c, (n + 1) // 2 AS n, count(*) AS kids,
      {', '.join(f'max(h{i}) FILTER (c % 2 = 0) AS a{i}' for i in range(8))}, {', '.join(f'max(h{i}) FILTER (c % 2 = 1) AS b{i}' for i in range(8))}
      FROM tree WHERE n > 1 GROUP BY id, level, c // 2, n"""
    pair = [f"a{i}" for i in range(8)] + [f"b{i}" for i in range(8)]
    ready = f"""SELECT id, level, c, n, kids, {', '.join(pair)}, {iv}, 0 AS lo, 64 AS len, CASE WHEN n = 1 THEN 12 ELSE 4 END AS flags,
      {', '.join(f'coalesce({p}, 0) AS m{i}' for i, p in enumerate(pair))} FROM ({parents})"""
    keep = f"id, level, c, n, kids, {', '.join(pair)}"
    nodes = ", ".join(f"CASE WHEN kids = 2 THEN r{i} ELSE a{i} END AS h{i}" for i in range(8))
    held = ", ".join(f"CASE WHEN kids = 2 THEN {p} END AS {p}" for p in pair)
    none = ", ".join(f"CAST(NULL AS UBIGINT) AS {p}" for p in pair)
    whole = " || ".join(_swap(f"h{i}") for i in range(8))
    both = " || ".join(_swap(p) for p in pair)
    size = " || ".join(f"printf('%02x', CAST((size >> {8 * k}) & 255 AS BIGINT))" for k in range(8))
    out = f"SELECT t.id, {whole} AS hash FROM tree t WHERE n = 1"
    if outboard:
        out = f"""SELECT t.id, t.hash, {size} || coalesce(o.nodes, '') AS outboard FROM ({out}) t JOIN (SELECT id, CAST(length(hx) // 2 AS BIGINT) AS size FROM source) s USING (id)
          LEFT JOIN (SELECT id, string_agg({both}, '' ORDER BY c << level, level DESC) AS nodes FROM tree WHERE a0 IS NOT NULL GROUP BY id) o USING (id)"""
    return f"""WITH RECURSIVE source AS MATERIALIZED ({source}),
    chunks AS (
      SELECT id, c, n, CAST(0 AS BIGINT) AS k, greatest(1, (length(chx) + 127) // 128) AS blocks, chx, {iv}
      FROM (SELECT id, n, c, substr(hx, {2 * CHUNK} * c + 1, {2 * CHUNK}) AS chx FROM (SELECT *, unnest(range(n)) AS c FROM (SELECT id, hx, greatest(1, (length(hx) + {2 * CHUNK - 1}) // {2 * CHUNK}) AS n FROM source)))
      UNION ALL
      SELECT id, c, n, k + 1, blocks, chx, {', '.join(f'r{i}' for i in range(8))} FROM ({_compress(blocks, 'id, c, n, k, blocks, chx')})),
    leaves AS MATERIALIZED (SELECT id, CAST(0 AS BIGINT) AS level, c, n, {none}, {listed} FROM chunks WHERE k = blocks),
    tree AS (
      SELECT * FROM leaves
      UNION ALL
      SELECT id, level, c, n, {held}, {nodes} FROM ({_compress(ready, keep)}))
    {out}"""
