"""Settings of an engine, from arguments or from environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """data_dir: the store's root. allowed_paths: folders that may be indexed, separated by colons; empty allows all."""

    data_dir: str = "~/.local/share/terrane"
    max_file_size_mb: int = 5
    allowed_paths: str = "/home:/projects:/workspace"
    log_level: str = "INFO"
    embedding_backend: str = "local"
    max_traversal_depth: int = 5

    @classmethod
    def from_environment(cls, prefix: str = "TERRANE_") -> Settings:
        """Variables named PREFIX and the setting in capitals; numbers are read as such."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**{k: int(v) if k.startswith("max_") else v for k, v in given.items()})

    @property
    def store_root(self) -> str:
        return os.path.expanduser(self.data_dir)

    @property
    def prefixes(self) -> tuple[str, ...]:
        return tuple(os.path.expanduser(p) for p in self.allowed_paths.split(":") if p)
