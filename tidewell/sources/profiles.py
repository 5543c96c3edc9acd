"""Named connections and storage places."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from tidewell.sources.files import ParquetSource
from tidewell.sources.jdbc import JdbcSource

# Fixed value: what a profile's name may be.
NAME = re.compile(r"[A-Za-z0-9._-]+")


def checked(name: str) -> str:
    """A profile's name: letters, digits, dots, underscores and hyphens."""
    if not NAME.fullmatch(name.strip()):
        raise ValueError(f"{name!r}: a name has letters, digits, dots, underscores and hyphens")
    return name.strip()


@dataclass
class ConnectionCatalog:
    """Connections by name; secrets stay out of what is printed."""

    profiles: dict[str, dict[str, Any]] = field(default_factory=dict, repr=False)

    def register(self, name: str, **options: Any) -> None:
        name = checked(name)
        if name in self.profiles:
            raise ValueError(f"{name} is registered already")
        self.profiles[name] = options

    def load(self, name: str, prefix: str, *, env_file: str | None = None, env: Mapping[str, str] | None = None, **more: Any) -> None:
        """A profile of variables like ``PREFIX_URL``; those of ``env_file`` (``NAME=value`` lines) come before the environment's, ``more`` before both."""
        found = dict(os.environ if env is None else env)
        if env_file:
            with open(env_file, encoding="utf-8") as file:
                for line in map(str.strip, file):
                    if line and not line.startswith("#") and "=" in line:
                        key, _, value = line.removeprefix("export ").partition("=")
                        found[key.strip()] = value.strip().strip("\"'")
        lead = f"{prefix.rstrip('_')}_"
        self.register(name, **{k[len(lead) :].lower(): v for k, v in found.items() if k.startswith(lead) and len(k) > len(lead)} | more)

    @classmethod
    def from_env(cls, prefix: str, env: Mapping[str, str] | None = None) -> ConnectionCatalog:
        """Profiles of variables like ``PREFIX_NAME_URL``; the last part is the option."""
        out = cls()
        for key, value in (os.environ if env is None else env).items():
            if key.startswith(f"{prefix}_") and key.count("_") >= 2:
                name, _, option = key[len(prefix) + 1 :].rpartition("_")
                out.profiles.setdefault(name.lower(), {})[option.lower()] = value
        return out

    def names(self) -> list[str]:
        return sorted(self.profiles)

    def jdbc(self, name: str, **more: Any) -> JdbcSource:
        if checked(name) not in self.profiles:
            raise KeyError(f"{name}: profiles are {', '.join(self.names())}")
        profile = dict(self.profiles[name])
        url, own = profile.pop("url"), {k: str(v) for k, v in profile.items()}
        return JdbcSource(url, options=own | more.pop("options", {}), **more)


@dataclass
class StorageCatalog:
    """Roots of stores by name; paths stay below them."""

    roots: dict[str, str] = field(default_factory=dict)
    settings: dict[str, dict[str, str]] = field(default_factory=dict, repr=False)

    def path(self, name: str, *parts: str) -> str:
        if any(p in ("", ".", "..") or "\0" in p or "\\" in p for part in parts for p in part.split("/")):
            raise ValueError("the path leaves its root")
        return "/".join([self.roots[name].rstrip("/"), *parts])

    def parquet(self, name: str, *parts: str, **more: Any) -> ParquetSource:
        return ParquetSource(self.path(name, *parts), **more)

    def configure(self, spark: SparkSession, name: str) -> None:
        """Hand the store's settings to Hadoop's file systems."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.settings.get(name, {}).items():
            conf.set(k, v)
