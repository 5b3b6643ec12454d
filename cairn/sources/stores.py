"""Stores of single objects and names, in folders or buckets.

Both backends go through one file-system interface. A folder is written through
a temporary file of the writer's own and a rename; a bucket's object appears as
a whole when its upload ends, in parts where it is large, so it needs neither.
"""

from __future__ import annotations

import os
import uuid
from contextlib import suppress
from dataclasses import dataclass
from typing import Any, BinaryIO, Protocol

from pyarrow import fs as files

from cairn.sources.config import ConfigError, store_path

#: Bytes that are copied at once.
PIECE = 4 << 20
Content = bytes | bytearray | memoryview | str | os.PathLike | BinaryIO


class BlobStore(Protocol):
    """Blobs by identifier: writes tell whether they worked, reads give None for what is absent."""

    def write_blob(self, cid: str, content: Content) -> bool: ...
    def write_outboard(self, cid: str, content: bytes) -> bool: ...
    def read_blob(self, cid: str) -> bytes | None: ...
    def read_outboard(self, cid: str) -> bytes | None: ...
    def exists(self, cid: str) -> bool: ...
    def size(self, cid: str) -> int: ...
    def delete(self, cid: str) -> bool: ...
    def close(self) -> None: ...


class RefStore(Protocol):
    """Names of identifiers; listing goes by whole path parts."""

    def write(self, ref: str, cid: str) -> bool: ...
    def read(self, ref: str) -> str | None: ...
    def exists(self, ref: str) -> bool: ...
    def list(self, prefix: str = "") -> list[str]: ...
    def delete(self, ref: str) -> bool: ...
    def close(self) -> None: ...


@dataclass
class Place:
    """A folder of a file system; ``renames``: whether objects must be renamed into place."""

    fs: files.FileSystem
    base: str
    renames: bool

    def path(self, *parts: str) -> str:
        return "/".join([self.base.rstrip("/"), *parts])

    def is_file(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == files.FileType.File

    def put(self, path: str, content: Content) -> None:
        """Write the whole of ``content``: bytes, an open file, or the path of a local one."""
        if isinstance(content, (str, os.PathLike)):
            with open(content, "rb") as f:
                return self.put(path, f)
        target = f"{path}.{uuid.uuid4().hex}.tmp" if self.renames else path
        try:
            if self.renames:
                self.fs.create_dir(os.path.dirname(path), recursive=True)
            with self.fs.open_output_stream(target) as out:
                if hasattr(content, "read"):
                    while piece := content.read(PIECE):
                        out.write(piece)
                else:
                    out.write(bytes(content))
            if self.renames:
                self.fs.move(target, path)
        except BaseException:
            if self.renames:
                with suppress(OSError):
                    self.fs.delete_file(target)
            raise

    def get(self, path: str) -> bytes | None:
        if not self.is_file(path):
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def drop(self, path: str) -> bool:
        if not self.is_file(path):
            return False
        self.fs.delete_file(path)
        return True


def place(uri: str | None, kind: str, **options: Any) -> Place:
    """Where a ``blocks+`` or ``refs+`` URI points; ``options`` go to the client of a bucket."""
    path = store_path(uri, kind)
    scheme, _, rest = path.partition("://")
    if scheme == "file":
        return Place(files.LocalFileSystem(), rest, True)
    return Place(files.S3FileSystem(**options), rest, False)


def blob_key(cid: str, ending: str = "") -> str:
    if not cid or "/" in cid or cid in (".", ".."):
        raise ValueError(f"not a blob key: {cid!r}")
    return f"blobs/{cid}{ending}"


def ref_key(ref: str) -> str:
    clean = ref[1:] if ref.startswith("/") else ref
    if not clean or ".." in clean.split("/"):
        raise ValueError(f"not a ref: {ref!r}")
    return f"refs/{clean}"


class Blobs:
    """``blobs/{cid}`` and ``blobs/{cid}.obao``; for single objects, not tables. Failed writes raise."""

    def __init__(self, at: Place):
        self.at = at
        if at.renames:
            at.fs.create_dir(at.path("blobs"), recursive=True)

    def write_blob(self, cid: str, content: Content) -> bool:
        self.at.put(self.at.path(blob_key(cid)), content)
        return True

    def write_outboard(self, cid: str, content: bytes) -> bool:
        self.at.put(self.at.path(blob_key(cid, ".obao")), content)
        return True

    def read_blob(self, cid: str) -> bytes | None:
        return self.at.get(self.at.path(blob_key(cid)))

    def read_outboard(self, cid: str) -> bytes | None:
        return self.at.get(self.at.path(blob_key(cid, ".obao")))

    def exists(self, cid: str) -> bool:
        return self.at.is_file(self.at.path(blob_key(cid)))

    def size(self, cid: str) -> int:
        found = self.at.fs.get_file_info(self.at.path(blob_key(cid)))
        return found.size if found.type == files.FileType.File else -1

    def delete(self, cid: str) -> bool:
        """The blob and its outboard; whether either was there."""
        return any([self.at.drop(self.at.path(blob_key(cid, ending))) for ending in ("", ".obao")])

    def close(self) -> None:
        """Nothing is held open."""


class Refs:
    """``refs/{path}`` objects that hold an identifier."""

    def __init__(self, at: Place):
        self.at = at
        if at.renames:
            at.fs.create_dir(at.path("refs"), recursive=True)

    def write(self, ref: str, cid: str) -> bool:
        self.at.put(self.at.path(ref_key(ref)), cid.encode())
        return True

    def read(self, ref: str) -> str | None:
        found = self.at.get(self.at.path(ref_key(ref)))
        return None if found is None else found.decode().strip()

    def exists(self, ref: str) -> bool:
        return self.at.is_file(self.at.path(ref_key(ref)))

    def list(self, prefix: str = "") -> list[str]:
        """Refs under a prefix of whole path parts, sorted."""
        bare, top = prefix.strip("/"), self.at.path("refs")
        found = self.at.fs.get_file_info(files.FileSelector(top, recursive=True, allow_not_found=True))
        names = [f.path[len(top) + 1 :] for f in found if f.type == files.FileType.File and not f.path.endswith(".tmp")]
        return sorted(x for x in names if not bare or x == bare or x.startswith(f"{bare}/"))

    def delete(self, ref: str) -> bool:
        """Whether the ref was there; folders that it leaves empty go too."""
        path = self.at.path(ref_key(ref))
        if not self.at.drop(path):
            return False
        folder = os.path.dirname(path)
        while self.at.renames and folder != self.at.path("refs") and not self.at.fs.get_file_info(files.FileSelector(folder)):
            self.at.fs.delete_dir(folder)
            folder = os.path.dirname(folder)
        return True

    def close(self) -> None:
        """Nothing is held open."""


def blob_store(uri: str | None, **options: Any) -> Blobs:
    return Blobs(place(uri, "blocks", **options))


def ref_store(uri: str | None, **options: Any) -> Refs:
    return Refs(place(uri, "refs", **options))


def of_kind(uri: str, **options: Any) -> Place:
    """The folder of a URI of either kind."""
    for kind in ("blocks", "refs"):
        if uri.startswith(f"{kind}+"):
            return place(uri, kind, **options)
    raise ConfigError(f"{uri!r} needs a blocks+ or refs+ scheme")
