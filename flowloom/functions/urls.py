"""Targets of request URLs: local paths, paths under a configured base, external boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.net import is_external_host

# Names of query fields that are sensitive.
SENSITIVE_QUERY = (
    r"(?:^|[_-])(authorization|cookie|password|passwd|pwd|secret|token|access[_-]?token|refresh[_-]?token|api[_-]?key|apikey|credential|credentials"
    r"|private[_-]?key|client[_-]?secret|session|sessionid|csrf|xsrf|baggage)(?:$|[_-])"
)
#: Characters that a URL parser would escape in a path, so that the path is not in its final form.
ESCAPED_IN_PATHS = r'[^\x21-\x7e]|["<>`{}]'


def query_names(query: Column) -> Column:
    """Decoded names of the fields of a query string, repeats included."""
    fields = F.filter(F.split(query, "&"), lambda f: f != "")
    return F.transform(fields, lambda f: F.coalesce(F.try_url_decode(F.substring_index(f, "=", 1)), F.substring_index(f, "=", 1)))


def is_sensitive_query_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")).rlike(SENSITIVE_QUERY)


def _query_facts(query: Column) -> tuple[Column, Column]:
    names = query_names(query)
    return F.size(names).alias("query_field_count"), F.exists(names, is_sensitive_query_name).alias("has_sensitive_query")


def _after_mark(url: Column) -> Column:
    """What follows the first ? and precedes a #, empty if there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def local_target(url: Column) -> Column:
    """A path of this site with an optional query, or null: no fragment, white space, backslash, bad escape, escaped separator or dot segment."""
    path = F.substring_index(url, "?", 1)
    dots = F.exists(F.split(path, "/"), lambda s: s.isin(".", ".."))
    ok = url.rlike("^/(?!/)") & ~url.rlike(r"[#\s\\]|%(?![0-9A-Fa-f]{2})") & ~dots & ~path.rlike(ESCAPED_IN_PATHS) & ~path.rlike("(?i)%2f|%5c|%2e")
    none = F.lit(None).cast("string")
    return F.when(ok, F.struct(path.alias("normalized_path"), *_query_facts(_after_mark(url)), none.alias("scheme"), none.alias("host"), F.lit(None).cast("int").alias("port"), F.lit(None).cast("boolean").alias("path_present")))


def external_target(url: Column) -> Column:
    """An absolute HTTP URL as a boundary: scheme, host, port where it is not the scheme's own, and whether there is a path; null with user info, fragment or an unsafe host."""
    form = r"(?i)^(https?)://(\[[^\]]*\]|[^/?#:@\s\\]*)(?::([0-9]*))?([/?#].*)?\z"
    scheme = F.lower(F.regexp_extract(url, form, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, form, 2)), r"^\[(.*)\]$", "$1")
    number = F.regexp_extract(url, form, 3)
    port = F.when(number != "", F.try_to_number(number, F.lit("9999999")).cast("int"))
    rest = F.regexp_extract(url, form, 4)
    own = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    ok = url.rlike(form) & is_external_host(host) & ~rest.rlike(r"[\s\\]|#.") & ((number == "") | F.coalesce(port.between(1, 65535), F.lit(False)))
    return F.when(ok, F.struct(
        F.lit("/").alias("normalized_path"), *_query_facts(_after_mark(rest)), scheme.alias("scheme"), host.alias("host"),
        F.when(~F.coalesce(own, F.lit(False)), port).alias("port"), (~F.regexp_extract(rest, "^([^?#]*)", 1).isin("", "/")).alias("path_present"),
    ))


def based_target(url: Column, base: str) -> Column:
    """A relative path under the only configured base path; null for anything but plain segments."""
    plain = r"[{}:?#\s\\%]|//|(^|/)\.\.?(/|$)"
    inside = (url != "") & ~url.startswith("/") & ~url.rlike(plain)
    fits = F.lit(base).rlike("^/(?!/)") & ~F.lit(base).rlike(plain)
    return F.when(inside & fits, local_target(F.concat(F.lit(base.rstrip("/") + "/"), url)))


def url_target(url: Column, base: str | None = None) -> Column:
    """The target of a request URL, null if it is none of the three kinds and so stays unbounded."""
    out = F.when(url.startswith("/"), local_target(url)).otherwise(external_target(url))
    return out if base is None else F.coalesce(out, based_target(url, base))


def unbounded_path(head: Column) -> Column:
    """The path of an unresolved template: the whole segments before its first placeholder, then {u0}."""
    prefix = F.when(head.startswith("/"), F.regexp_replace(head, "/[^/]*$", "")).otherwise("")
    return F.regexp_replace(F.concat(F.coalesce(prefix, F.lit("")), F.lit("/{u0}")), "/+", "/")
