"""JSON values of any depth: what they hold, checked by rows, and their canonical and redacted texts.

Spark has no recursive walk of a JSON value, so a small helper lists a value's entries;
what an entry may hold is then decided by the same column expressions as elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.text import is_secret_key, is_secret_value
from flowloom.guards import SENSITIVE_HEADER, SENSITIVE_NAME

# Keys that may look like secrets; keys of runtime material; forms of ids and names that may look like secrets.
ALLOWED_KEYS = ("hasSensitiveQuery", "hasSensitiveFields")
FRAGMENT_KEYS = (*ALLOWED_KEYS, "token")
RUNTIME_KEYS = ("captureId", "eventId", "receivedAt", "runId", "runtimeScopeId", "timestamp")
ID = "^[{}]_[0-9a-f]{{64}}$"
DOTTED = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"

#: An escape that may be half of a character beyond 16 bits.
HALF = re.compile(r"\\u[dD][89a-fA-F]")

ENTRIES = "array<struct<key:string,value:string,kind:string>>"


def _mapped(schema: str, of: Callable[[object], object]):
    def each(text: str | None) -> object:
        try:
            if text is None:
                return None
            value = json.loads(text)
            if HALF.search(text):  # half a character can't be written as text
                json.dumps(value, ensure_ascii=False).encode()
            return of(value)
        except (ValueError, RecursionError):
            return None

    return F.pandas_udf(lambda texts: pd.Series([each(t) for t in texts], dtype=object), schema)


def entries(text: Column) -> Column:
    """Every member and element of a JSON text, at any depth: its key (null in a list), its text if it is a string, its kind; null if broken, or if a string holds half a character."""

    def of(value: object) -> list[dict]:
        out, left = [], [(None, value)]
        while left:
            key, v = left.pop()
            kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "string" if isinstance(v, str) else "other"
            out.append({"key": key, "value": v if kind == "string" else None, "kind": kind})
            left.extend(v.items() if kind == "object" else ((None, x) for x in v) if kind == "list" else ())
        return out

    return _mapped(ENTRIES, of)(text)


def holds_secret(found: Column) -> Column:
    """Whether some entry has a secret's key or value; null for a broken text."""
    bad_key = lambda e: e["key"].isNotNull() & ~e["key"].isin(*ALLOWED_KEYS) & is_secret_key(e["key"])
    return F.exists(found, lambda e: F.coalesce(bad_key(e), F.lit(False)) | F.coalesce(is_secret_value(e["value"]), F.lit(False)))


def fragment_secret(found: Column) -> Column:
    """The same for a fragment on its way in, where ids and names in their own places may look like secrets."""

    def excused(e: Column) -> Column:
        key, value = e["key"], e["value"]
        plain = ~is_secret_value(value, generic=False)
        return (
            ((key == "pythonQualifiedName") & value.rlike(DOTTED)) | ((key == "repositorySetId") & value.rlike("^[0-9a-f]{64}$")) | ((key == "id") & value.rlike(ID.format("nerd")))
            | ((key == "nodeId") & value.rlike(ID.format("n"))) | ((key == "edgeId") & value.rlike(ID.format("e"))) | (key.isin("key", "identity", "source", "target") & plain)
            | (key.isin("label", "symbol") & value.rlike(DOTTED) & plain)
        )

    bad_key = lambda e: e["key"].isNotNull() & ~e["key"].isin(*FRAGMENT_KEYS) & is_secret_key(e["key"])
    bad_value = lambda e: F.coalesce(is_secret_value(e["value"]), F.lit(False)) & ~F.coalesce(excused(e), F.lit(False))
    return F.exists(found, lambda e: F.coalesce(bad_key(e), F.lit(False)) | bad_value(e))


def holds_runtime_material(found: Column) -> Column:
    """Whether some entry is one that only running code gives."""
    return F.exists(found, lambda e: F.coalesce(e["key"].isin(*RUNTIME_KEYS) | ((e["key"] == "kind") & (e["value"] == "observed")), F.lit(False)))


def canonical(text: Column) -> Column:
    """Sorted keys, no spaces, characters as they are; null for what is no JSON or holds NaN, infinity or half a character."""

    def of(value: object) -> str | None:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

    return _mapped("string", of)(text)


def redacted(text: Column) -> Column:
    """Canonical text without the members whose key names a secret, at any depth."""

    def of(value: object) -> object:
        if isinstance(value, dict):
            return {k: of(v) for k, v in value.items() if not (SENSITIVE_NAME.search(k) or SENSITIVE_HEADER.search(k))}
        return [of(v) for v in value] if isinstance(value, list) else value

    return _mapped("string", lambda v: json.dumps(of(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False))(text)
