"""A Spark data source of source trees: folders that are not wanted are never entered, and what can't be read is a row."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES = 1 << 20
# Folders that are no source, of Python trees and of frontend trees, and suffixes of sources.
PYTHON_IGNORED = (".agents", ".aws", ".config", ".git", ".ssh", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "site-packages")
FRONTEND_IGNORED = (
    "node_modules", ".git", ".agents", ".venv", "venv", "__pycache__", ".ssh", ".aws", ".config", ".quasar", ".next", ".nuxt", ".cache", ".turbo", ".svelte-kit", ".tox", ".mypy_cache", ".pytest_cache",
    ".pnpm-store", "bower_components", "build", "coverage", "dist", "out", "site-packages", "staticfiles", "target", "vendor",
)
SUFFIXES = {"python": (".py",), "frontend": (".js", ".jsx", ".ts", ".tsx", ".vue")}
IGNORED = {"python": PYTHON_IGNORED, "frontend": FRONTEND_IGNORED}
#: Folders that the driver opens until there are so many for the tasks.
PARTITIONS = 64


class Folder(InputPartition):
    """One folder of the tree; ``deep`` if all below it belongs to the partition."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        kind = options.get("kind", "python")
        self.suffixes, self.ignored, self.most = SUFFIXES[kind], frozenset(IGNORED[kind]), int(options.get("mostbytes", MOST_BYTES))
        self.wanted = int(options.get("partitions", PARTITIONS))
        if os.path.islink(options["path"].rstrip("/")):
            raise ValueError("the root of a source tree must not be a link")

    def _open(self, folder: str) -> tuple[list[str], list[os.DirEntry]] | None:
        """Folders to enter and files of ``folder`` by name, without links and ignored folders; None if it can't be read."""
        try:
            with os.scandir(folder) as found:
                entries = sorted((e for e in found if e.name not in self.ignored and not e.is_symlink()), key=lambda e: e.name)
                return [e.path for e in entries if e.is_dir(follow_symlinks=False)], [e for e in entries if e.is_file(follow_symlinks=False)]
        except OSError:
            return None

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are enough: those opened are read without what is below, the last level with it."""
        flat, level = [], [self.root]
        while level and len(flat) + len(level) < self.wanted:
            opened = [(f, self._open(f)) for f in level]
            flat += [f for f, _ in opened]
            level = [below for _, found in opened if found for below in found[0]]
        return [Folder(f, False) for f in flat] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        left = [partition.path]
        while left:
            folder = left.pop()
            found = self._open(folder)
            if found is None:
                yield self._row(folder, None, None, "source_read_failed")
                continue
            if partition.deep:
                left.extend(reversed(found[0]))
            for entry in found[1]:
                if not entry.name.endswith(self.suffixes):
                    continue
                size = None
                try:
                    size = entry.stat(follow_symlinks=False).st_size
                    if size <= self.most:
                        with open(entry.path, "rb") as file:
                            yield self._row(entry.path, size, file.read(self.most + 1), "ok")
                            continue
                except OSError:
                    pass
                yield self._row(entry.path, size, None, "source_read_failed")

    def _row(self, path: str, size: int | None, content: bytes | None, status: str) -> tuple:
        below = PurePosixPath(os.path.relpath(path, self.root)).as_posix()
        encoded = "/".join(quote(os.fsencode(part), safe="~") for part in below.split("/"))
        return os.fsencode(below).decode("utf-8", "replace"), encoded, size, content, status


class SourceTree(DataSource):
    """(path, encoded, length, content, status) of the sources below ``path``; options: kind (python, frontend), mostBytes, partitions.

    Paths are relative to the root. The tree must be on a file system that the driver and all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, encoded string, length long, content binary, status string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_sources(spark: SparkSession, root: str, kind: str = "python") -> tuple[DataFrame, DataFrame]:
    """(files (path, encoded, text), diagnostics (code, path)): bytes that are no UTF-8 become replacement characters."""
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").option("kind", kind).load(root)
    ok = rows.filter("status = 'ok'").selectExpr("path", "encoded", "make_valid_utf8(string(content)) AS text")
    return ok, rows.filter("status <> 'ok'").selectExpr("status AS code", "path")
