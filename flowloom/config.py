"""Projects and repositories to analyse."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from pathlib import Path, PurePath

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Endpoints:
    """How URLs of the project are read: bases that are stripped, origins of its own."""

    base_paths: tuple[str, ...] = ()
    first_party_origins: dict[str, str] = field(default_factory=dict)
    trusted_proxy_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """A project of named source roots: ``repositories`` maps each namespace to its folder."""

    project: str
    repositories: dict[str, str]
    endpoints: Endpoints = Endpoints()

    @classmethod
    def of(cls, project: str, roots: list[str | dict[str, str]], endpoints: Endpoints = Endpoints()) -> Config:
        """``roots``: paths, NAME=PATH or {namespace, path}; a bare path is named after its folder."""
        if not roots:
            raise ValueError("at least one repository is needed")
        if not 1 <= len(project) <= 128 or unicodedata.normalize("NFC", project) != project or re.search(r"[\x00-\x1f\x7f]", project):
            raise ValueError(f"no project name: {project!r}")
        found: dict[str, str] = {}
        for root in roots:
            if isinstance(root, dict):
                if set(root) != {"namespace", "path"}:
                    raise ValueError("a repository has a namespace and a path")
                name, path = root["namespace"], root["path"]
            else:
                name, equals, path = root.partition("=")
                name, path = (name, path) if equals else (PurePath(root).name, root)
            path = Path(path).resolve().as_posix() if "://" not in path else path
            if not re.fullmatch(r"[a-z][a-z0-9._-]{0,63}", name) or name in found or path in found.values():
                raise ValueError(f"repository names are lower case and unique, and so are their folders: {name!r}")
            found[name] = path
        return cls(project, dict(sorted(found.items())), endpoints)

    @property
    def repository_set_id(self) -> str:
        e = self.endpoints
        content = {
            "schemaVersion": 2, "project": self.project,
            "repositories": [{"namespace": n, "resolvedRoot": p} for n, p in self.repositories.items()],
            "endpoint": {"firstPartyOrigins": e.first_party_origins, "basePaths": list(e.base_paths), "trustedProxyPrefixes": list(e.trusted_proxy_prefixes)},
        }
        return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def public(self) -> dict[str, object]:
        """What may be shown: no folders."""
        return {"project": self.project, "schemaVersion": 2, "repositorySetId": self.repository_set_id, "repositories": [{"namespace": n} for n in self.repositories]}

    def namespaces(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n,) for n in self.repositories], "namespace string")
