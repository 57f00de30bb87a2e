"""Paths, endpoints and declared routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUILT_IN_CONVERTERS = ("int", "str", "slug", "uuid")
#: Members that a built-in converter accepts.
CONVERTER_MEMBERS = {
    "int": r"^[0-9]+$",
    "str": r"^[^/]+$",
    "slug": r"^[-a-zA-Z0-9_]+$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}


def decoded(path: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))


def is_strict_endpoint(path: Column) -> Column:
    """Origin-form without query, fragment, backslash, controls, bad escapes or dot segments."""
    text = decoded(path)
    return F.coalesce(
        path.rlike(r"^/(?!/)[^?#\\\x00-\x20\x7f]*$") & ~path.rlike("%(?![0-9A-Fa-f]{2})") & text.isNotNull()
        & ~text.rlike(r"[\x00-\x1f\x7f\\]") & ~F.exists(F.split(text, "/"), lambda s: s.isin(".", "..")),
        F.lit(False),
    )


def is_repo_path(path: Column) -> Column:
    """Relative, with plain separators, valid escapes and no dot segment even when decoded twice."""
    once, twice = decoded(path), decoded(decoded(path))
    dots = lambda p: F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(
        (path != "") & ~path.rlike(r"^/|[\x00-\x1f\x7f\\]|%(?![0-9A-Fa-f]{2})|^[A-Za-z]:") & ~dots(path) & ~dots(once) & ~dots(twice) & ~path.rlike("(?i)%(25)*(2f|5c)"),
        F.lit(False),
    )


def strip_base(path: Column, prefixes: list[str]) -> Column:
    """``path`` without the longest prefix that ends at a segment border; the prefix itself becomes /."""
    out = path
    for prefix in sorted({p.rstrip("/") for p in prefixes if p.rstrip("/")}, key=len):
        inside = (path == prefix) | path.startswith(prefix + "/")
        out = F.when(inside, F.when(path == prefix, "/").otherwise(F.substring(path, F.lit(len(prefix) + 1), F.char_length(path)))).otherwise(out)
    return out


def endpoint_id(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), path)


def url_path(url: Column) -> Column:
    """The path of an absolute URL; / if it has none; null with user info, or if it is no URL."""
    rest = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)([^?#]*)", 2)
    ok = url.rlike(r"^[a-z]+://[^/?#@]+([/?#]|$)")
    return F.when(ok, F.when(rest == "", "/").otherwise(rest))


def placeholders_contiguous(path: Column, letter: str = "p") -> Column:
    """Whole-segment placeholders {p0}, {p1}, ... in this order and nothing else in braces."""
    braces = F.filter(F.split(path, "/"), lambda s: s.contains("{") | s.contains("}"))
    want = F.transform(F.sequence(F.lit(1), F.greatest(F.size(braces), F.lit(1))), lambda i: F.concat(F.lit("{" + letter), (i - 1).cast("string"), F.lit("}")))
    return (F.size(braces) == 0) | (F.slice(want, 1, F.size(braces)) == braces)


def django_route(prefix: Column, route: Column) -> tuple[Column, Column, Column]:
    """(declared, normalized, converters) of a prefix and a route with <converter:name> segments."""
    declared = F.regexp_replace(F.concat(F.lit("/"), prefix, route), "/+", "/")
    segments = F.split(declared, "/")
    dynamic = F.filter(segments, lambda s: s.rlike("^<.*>$"))
    rank = lambda i: F.size(F.filter(F.slice(segments, 1, i), lambda s: s.rlike("^<.*>$")))
    normal = F.array_join(F.transform(segments, lambda s, i: F.when(s.rlike("^<.*>$"), F.concat(F.lit("{p"), rank(i).cast("string"), F.lit("}"))).otherwise(s)), "/")
    kinds = F.transform(dynamic, lambda s: F.when(s.contains(":"), F.regexp_extract(s, "^<([^:>]+):", 1)).otherwise("str"))
    return declared, normal, kinds


def nuxt_route(file: Column) -> Column:
    """A page file's route: index vanishes, [x] becomes :x and [...x] :x*."""
    p = F.regexp_replace(file, r"\.vue$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\[\.\.\.(\w+)\]", ":$1*"), r"\[(\w+)\]", ":$1")
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/index(?=/|$)", "")
    return F.when(p == "", "/").otherwise(p)


def converter_accepts(converter: Column, members: Column) -> Column:
    """Whether all members of a finite domain pass a built-in converter."""
    out = F.lit(False)
    for name, pattern in CONVERTER_MEMBERS.items():
        out = F.when(converter == name, F.forall(members, lambda m, p=pattern: m.rlike(p))).otherwise(out)
    return out
