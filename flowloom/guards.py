"""Checks of what a run is given, made on the driver before any job starts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql.types import StructType

# Folders of credentials in a home; what makes the name of a setting or a header sensitive.
CREDENTIAL_FOLDERS = (".ssh", ".aws", ".config")
SENSITIVE_NAME = re.compile(r"token|cookie|password|secret|credential|private[_-]?key|session|request[_-]?body|^body$", re.I)
SENSITIVE_HEADER = re.compile(r"cookie|authorization|token|password|session|secret|baggage", re.I)


class RootError(ValueError):
    """A folder that must not be analysed."""


def _credentials(path: Path) -> bool:
    return any(path.is_relative_to(Path.home().absolute() / name) for name in CREDENTIAL_FOLDERS)


def analysis_root(workspace: str | Path, given: str | Path) -> Path:
    """The real folder that ``given`` names, a relative one below ``workspace``; raises RootError for any doubtful one.

    Doubtful are separators in disguise, ways up, symbolic links, the file system's root,
    folders of credentials, and what is no folder.
    """
    raw = plain = str(given or "")
    for _ in range(8):
        plain = unquote(plain)
    if not raw or "\\" in raw + plain or re.search(r"%(?:2f|5c)", raw, re.I):
        raise RootError("empty, or with a separator in disguise")
    asked = Path(raw).expanduser()
    if ".." in asked.parts or ".." in Path(plain).parts:
        raise RootError("leads upwards")
    base = Path(workspace).resolve(strict=True)
    whole = base / asked
    if whole == Path(whole.anchor) or _credentials(whole.absolute()):
        raise RootError("the root of all, or credentials")
    if any(p.is_symlink() for p in (whole, *whole.parents)):
        raise RootError("behind a symbolic link")
    if not whole.is_dir():
        raise RootError("no folder")
    real = whole.resolve(strict=True)
    if not asked.is_absolute() and not real.is_relative_to(base):
        raise RootError("outside the workspace")
    if _credentials(real):
        raise RootError("credentials")
    return real


def sensitive_settings(settings: Mapping[str, object], approved: bool = False) -> list[str]:
    """Names of settings that must not be there: sensitive ones with a value, unless approved."""
    return [] if approved else sorted(str(k) for k, v in settings.items() if SENSITIVE_NAME.search(str(k)) and v not in (None, "", False))


def schema_faults(found: StructType, expected: StructType) -> list[str]:
    """Columns of ``expected`` that ``found`` lacks, has with another type, or has beyond them; nullability, which Parquet does not keep, is not compared."""
    types = lambda schema: {f.name: f.dataType.simpleString() for f in schema}
    a, b = types(found), types(expected)
    return sorted([f"missing {n}" for n in b.keys() - a.keys()] + [f"type {n}" for n in a.keys() & b.keys() if a[n] != b[n]] + [f"unknown {n}" for n in a.keys() - b.keys()])
