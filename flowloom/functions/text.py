"""Secrets, timestamps, labels and search text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a secret.
SECRET_KEYS = (
    "authorization", "cookie", "set_cookie", "password", "passwd", "pwd", "secret", "token", "access_token", "refresh_token",
    "api_key", "apikey", "credential", "credentials", "private_key", "client_secret", "session", "sessionid", "csrf", "xsrf",
    "baggage", "request_body", "response_body",
)
SECRET_PATTERNS = (
    r"(?i)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
    r"(?i)\b(?:bearer|basic)\s+[A-Za-z0-9._~+/-]{8,}\b",
    r"\b[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"(?i)\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"(?i)\bxox[baprs]-[^\s]{10,}\b",
    r"(?i)\b(?:authorization|cookie|set[ _-]?cookie|password|passwd|pwd|secret|token|access[ _-]?token|refresh[ _-]?token|api[ _-]?key|apikey|credential|credentials|private[ _-]?key|client[ _-]?secret|session|sessionid|csrf|xsrf|baggage)\s*[:=]\s*\S+",
    r"(?<![A-Za-z0-9])[A-Za-z0-9+_-]{32,}(?![A-Za-z0-9+_-])",
)
SENSITIVE_FIELDS = r"(?i)(?:token|secret|password|passwd|auth|session|cookie|api[-_]?key|credential)"


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """``text`` in a Unicode normal form; apply it before the predicates below where texts may hold compatibility characters."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return F.pandas_udf(normal, StringType())(text)


def is_normal(text: Column, form: str = "NFC") -> Column:
    return text == normal_form(text, form)


def is_secret_value(value: Column, generic: bool = True) -> Column:
    """Whether a value looks like a secret; the last, generic pattern is optional."""
    return reduce(Column.__or__, [value.rlike(p) for p in SECRET_PATTERNS[: None if generic else -1]])


def is_secret_key(key: Column) -> Column:
    """Whether some run of a key's words is a secret's name."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(key, "([a-z])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda p: p != "")
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(parts, i, n), "_")))
    )
    return (F.size(parts) > 0) & F.arrays_overlap(runs, F.array(*map(F.lit, SECRET_KEYS)))


def timestamp_ms(value: Column) -> Column:
    """Two accepted notations to UTC text with milliseconds (further digits cut); null for others."""
    plain = value.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    zulu = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z$")
    return rendered_ms(F.when(plain | zulu, F.try_to_timestamp(value)))


def rendered_ms(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strongest(kinds: Column) -> Column:
    """observed before unresolved before inferred."""
    return F.when(F.array_contains(kinds, "observed"), "observed").when(F.array_contains(kinds, "unresolved"), "unresolved").otherwise("inferred")


def kind_words(kind: Column) -> Column:
    return F.translate(kind, "_", " ")


def query_terms(text: Column) -> Column:
    """Lower-cased terms of a search text."""
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")


def matches_terms(haystack: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.lower(haystack).contains(t))


def authority(host: Column, port: Column) -> Column:
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.when(port.isNull(), shown).otherwise(F.concat(shown, F.lit(":"), port.cast("string")))


def source_display(path: Column, line: Column, symbol: Column) -> Column:
    return F.concat_ws(":", F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), line.cast("string"), symbol)
