"""File operations on store URIs that pass through to the file system below, unhashed."""

from __future__ import annotations

import os
from datetime import datetime
from typing import Any

from pyarrow import fs as files

from cairn.sources.config import ConfigError
from cairn.sources.stores import Place, of_kind


def _at(uri: str) -> tuple[Place, str]:
    at = of_kind(uri)
    return at, at.base


def _both(source: str, target: str) -> tuple[files.FileSystem, str, str]:
    (a, x), (b, y) = _at(source), _at(target)
    if a.renames != b.renames:
        raise ConfigError("both paths must be in stores of one kind")
    return a.fs, x, y


def create_directory(uri: str) -> None:
    at, path = _at(uri)
    at.fs.create_dir(path, recursive=True)


def copy(source: str, target: str) -> None:
    fs, a, b = _both(source, target)
    fs.copy_file(a, b)


def move(source: str, target: str) -> None:
    fs, a, b = _both(source, target)
    fs.move(a, b)


def delete(uri: str) -> None:
    """A file or an empty folder; an error if there is neither."""
    at, path = _at(uri)
    kind = at.fs.get_file_info(path).type
    if kind == files.FileType.Directory:
        if at.fs.get_file_info(files.FileSelector(path)):
            raise OSError(f"{uri!r} is not empty")
        at.fs.delete_dir(path)
    else:
        at.fs.delete_file(path)


def check_access(uri: str) -> None:
    """An error unless the path exists."""
    if attributes(uri)["kind"] == "absent":
        raise FileNotFoundError(uri)


def attributes(uri: str) -> dict[str, Any]:
    """``kind`` (file, directory or absent), ``size`` and ``modified``."""
    at, path = _at(uri)
    found = at.fs.get_file_info(path)
    kinds = {files.FileType.File: "file", files.FileType.Directory: "directory"}
    return {"kind": kinds.get(found.type, "absent"), "size": found.size, "modified": found.mtime}


def set_modified(uri: str, when: datetime) -> None:
    """Set the time of a local file; other stores keep their own clock."""
    at, path = _at(uri)
    if not at.renames:
        raise ConfigError("buckets set times themselves")
    os.utime(path, (when.timestamp(), when.timestamp()))


def is_hidden(uri: str) -> bool:
    return os.path.basename(_at(uri)[1]).startswith(".")


def same_file(a: str, b: str) -> bool:
    fs, x, y = _both(a, b)
    if isinstance(fs, files.LocalFileSystem) and os.path.exists(x) and os.path.exists(y):
        return os.path.samefile(x, y)
    return x == y
