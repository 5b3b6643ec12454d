"""Path and URI functions over string columns; the separator is ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(first: Column, *more: Column) -> Column:
    return F.concat_ws("/", first, *more)


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def root(path: Column) -> Column:
    return F.when(is_absolute(path), "/")


def file_name(path: Column) -> Column:
    """After the last separator; null for the root and the empty path."""
    return F.when((path != "") & (path != "/"), F.substring_index(path, "/", -1))


def parent(path: Column) -> Column:
    """Before the last separator; ``/`` for children of the root and the root itself."""
    cut = F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(cut == "", "/").otherwise(cut))


def names(path: Column) -> Column:
    """The parts after one leading separator; empty parts count, but for those at the end."""
    inner = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/"))


def name_count(path: Column) -> Column:
    return F.size(names(path))


def name(path: Column, index: int) -> Column:
    """Part ``index`` from 0; an error outside the path."""
    if index < 0:
        raise ValueError("index")
    return F.when(name_count(path) > index, F.get(names(path), index)).otherwise(F.raise_error(F.lit("index is out of range")).cast("string"))


def subpath(path: Column, begin: int, end: int) -> Column:
    """Parts ``begin`` to ``end - 1``, relative; an error outside the path."""
    if begin < 0 or begin >= end:
        raise ValueError("begin and end")
    ok = name_count(path) >= end
    return F.when(ok, F.array_join(F.slice(names(path), begin + 1, end - begin), "/")).otherwise(
        F.raise_error(F.lit("subpath is out of range")).cast("string")
    )


def starts_with(path: Column, other: Column, parts: bool = False) -> Column:
    """A string prefix; with ``parts``, whole names only."""
    if not parts:
        return path.startswith(other)
    bare = F.regexp_replace(other, "/$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def ends_with(path: Column, other: Column) -> Column:
    return path.endswith(other)


def normalize(path: Column) -> Column:
    """Without ``.`` and empty parts; ``..`` removes the part before it, if any."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when((x == "") | (x == "."), done)
        .when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.when(is_absolute(path), "/").otherwise(""), F.array_join(kept, "/"))


def resolve(path: Column, other: Column, keep_root: bool = True) -> Column:
    """``other`` under ``path``, joined as they are. ``keep_root=False``: a base of ``/`` gives ``other`` alone."""
    at_root = F.concat(F.lit("/"), other) if keep_root else other
    return (
        F.when(is_absolute(other), other)
        .when(path == "", other)
        .when(path == "/", at_root)
        .otherwise(F.concat(path, F.lit("/"), other))
    )


def resolve_sibling(path: Column, other: Column) -> Column:
    return F.when(parent(path).isNull(), other).otherwise(resolve(parent(path), other))


def relativize(path: Column, other: Column, strict: bool = True) -> Column:
    """What is left of ``other`` after the string prefix ``path``; if it is none an error, or null unless ``strict``."""
    rest = F.substring(other, F.length(path) + 1, F.length(other))
    found = F.when((is_absolute(path) == is_absolute(other)) & other.startswith(path), F.regexp_replace(rest, "^/", ""))
    if not strict:
        return found
    known = path.isNotNull() & other.isNotNull()
    return F.when(known & found.isNull(), F.raise_error(F.lit("no common base")).cast("string")).otherwise(found)


def to_uri(path: Column, scheme: str = "file") -> Column:
    return F.concat(F.lit(f"blocks+{scheme}://"), path)


def parse_store_uri(uri: Column) -> Column:
    """``struct(scheme, host, port, path)`` of ``blocks+scheme://...``; ``blocks`` alone is ``file``."""
    ok = uri.rlike(r"^(blocks|refs)(\+[a-z][a-z0-9.-]*)?:")
    part = lambda k: F.regexp_extract(uri, r"^(?:blocks|refs)(?:\+([a-z][a-z0-9.-]*))?:(?://(?:[^@/]*@)?([^/:?#]*)(?::([0-9]+))?)?([^?#]*)", k)
    host = F.when(part(2) != "", part(2))
    return F.when(
        ok,
        F.struct(
            F.when(part(1) == "", "file").otherwise(part(1)).alias("scheme"),
            host.alias("host"),
            F.when(part(3) == "", "-1").otherwise(part(3)).alias("port"),
            part(4).alias("path"),
        ),
    )


def underlying_uri(uri: Column) -> Column:
    """The store's own URI, without query, fragment and user."""
    p = parse_store_uri(uri)
    port = F.when(p["port"] != "-1", F.concat(F.lit(":"), p["port"])).otherwise("")
    return F.concat(p["scheme"], F.lit("://"), F.coalesce(p["host"], F.lit("")), port, p["path"])


def is_store_uri(uri: Column) -> Column:
    return F.coalesce(uri.rlike(r"^(blocks|refs)\+[a-z][a-z0-9+.-]*:\S+$"), F.lit(False))
