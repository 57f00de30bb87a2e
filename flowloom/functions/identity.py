"""Content-addressed ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short escapes of JSON.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def escaped(text: Column) -> Column:
    """``text`` as a JSON string with lower-case escapes of all controls and all characters beyond ASCII, the latter by UTF-16 unit."""

    def one(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when((c < " ") | (c > "~"), units).otherwise(c)
        for plain, short in SHORT.items():
            out = F.when(c == plain, short).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), one), ""), F.lit('"'))


def stable_id(prefix: str, *parts: Column | str, ascii_only: bool = False, plain: bool = False) -> Column:
    """``prefix`` and the sha256 of the parts as a compact JSON array; null if a part is.

    Parts of printable ASCII alone are written as they are, others character by character;
    ``ascii_only`` promises the former, ``plain`` that no part needs an escape in JSON either, as
    numbers and ids don't. Either way no row leaves generated code for Python.
    """
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    if plain:
        between = [x for c in columns for x in (F.lit('","'), c)][1:]
        return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit('["'), *between, F.lit('"]')), 256))
    array = F.array(*columns)
    native = F.sha2(F.to_json(array), 256)
    if ascii_only:
        return F.concat(F.lit(prefix), native)
    plain = F.concat(*columns).rlike(r"^[\x20-\x7e]*$")
    slow = F.concat(F.lit("["), F.concat_ws(",", *map(escaped, columns)), F.lit("]"))
    return F.concat(F.lit(prefix), F.when(plain, native).when(~plain, F.sha2(slow, 256)))


def node_id(repository: Column, path: Column, kind: Column, key: Column, ascii_only: bool = False) -> Column:
    return stable_id("n_", "node", repository, path, kind, key, ascii_only=ascii_only)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return stable_id("e_", "edge", source, target, kind, ascii_only=True)


def route_id(repository: Column, framework: Column, path: Column, node: Column) -> Column:
    return stable_id("r_", repository, framework, path, node, ascii_only=True)


def framed(tag: str, payload: Column) -> Column:
    """A typed cell as bytes: tag, length in eight hex digits, colon, payload."""
    data = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    size = F.lpad(F.lower(F.hex(F.octet_length(data))), 8, "0")
    return F.concat(F.lit(tag).cast("binary"), size.cast("binary"), F.lit(":").cast("binary"), data)


def digest(domain: str, *frames: Column) -> Column:
    """sha256 over a domain name and framed cells."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), *frames), 256)
