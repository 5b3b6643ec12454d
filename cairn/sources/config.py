"""Configuration of stores: parsing, validation and the folder of a URI."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit


class ConfigError(ValueError):
    pass


@dataclass
class Section:
    uri: str | None = None

    @classmethod
    def parse(cls, value: Any) -> Section:
        uri = value.get("uri") if isinstance(value, dict) else None
        return cls(None if uri is None else str(uri))


@dataclass
class Config:
    enabled: bool = False
    storage: Section = field(default_factory=Section)
    refs: Section = field(default_factory=Section)
    read_locations: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, value: dict | None) -> Config:
        """Nothing or an empty map is disabled; any value that is not falsy enables."""
        if not value:
            return cls()
        listed = value.get("readLocations")
        return cls(
            bool(value.get("enabled")),
            Section.parse(value.get("storage")),
            Section.parse(value.get("refs")),
            [str(x) for x in listed] if isinstance(listed, list) else [],
        )

    def validate(self) -> None:
        if not self.enabled:
            return
        for name, uri in (("storage.uri", self.storage.uri), ("refs.uri", self.refs.uri)):
            if not uri:
                raise ConfigError(f"{name} is required")
            validate_uri(uri, name)
        for uri in self.read_locations:
            validate_uri(uri, "readLocations")


def validate_uri(uri: str, name: str) -> None:
    if not uri or not re.match(r"(blocks|refs)\+", uri):
        raise ConfigError(f"{name}: {uri!r} needs a blocks+ or refs+ scheme")
    rest = uri.split("+", 1)[1]
    if re.search(r"\s", rest) or not urlsplit(rest).scheme:
        raise ConfigError(f"{name}: {uri!r} does not parse")


def store_path(uri: str | None, kind: str) -> str:
    """The folder that Spark reads for a ``blocks+`` or ``refs+`` URI; ``s3`` buckets through ``s3a``."""
    if not uri:
        raise ConfigError("a store needs a URI")
    if not uri.startswith(f"{kind}+"):
        raise ConfigError(f"{uri!r} needs the {kind}+ scheme")
    parts = urlsplit(uri.split("+", 1)[1])
    if parts.scheme == "file":
        return f"file://{parts.path.rstrip('/') or '/'}"
    if parts.scheme == "s3":
        return f"s3a://{parts.netloc}/{parts.path.strip('/')}".rstrip("/")
    raise ConfigError(f"unknown store {parts.scheme!r}")
