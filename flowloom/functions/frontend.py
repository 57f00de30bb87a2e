"""Names, routes and calls in browser sources as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that a client's member is named after; the reason given for a node's evidence by kind.
MEMBER_VERBS = ("post", "put", "patch", "delete")
DEFAULT_REASONS = {
    "unresolved_target": "dynamic_target_unproven",
    "frontend_route": "ast_route_declaration",
    "request_payload": "request_payload_shape",
    "http_call": "literal_url",
    "external_service": "external_boundary",
}
OTHER_REASON = "ast_symbol_declaration"
FRAMEWORKS = ("react", "vue", "nuxt")


def component_kind(name: Column) -> Column:
    return F.when(name.endswith("Page"), "page").otherwise("component")


def is_component_name(name: Column) -> Column:
    return name.rlike("^[A-Z]") & ~name.isin("Route", "Routes", "Fragment")


def http_method(callee: Column, has_option: Column, option: Column) -> Column:
    """The verb of a call: by the member's name, else the option ``method``, null if that is no literal, else GET."""
    by_option = F.when(F.coalesce(has_option, F.lit(False)), F.upper(option)).otherwise("GET")
    named = [(F.coalesce(callee.endswith(f".{verb}"), F.lit(False)), F.lit(verb.upper())) for verb in MEMBER_VERBS]
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(named), by_option)


def is_strict_route(path: Column, stars: bool = False) -> Column:
    """Rooted, no query, fragment, backslash or space; parameters are whole segments; a star segment only if ``stars``."""
    refused = [".", ".."] if stars else [".", "..", "*"]
    segment = lambda s: ~s.isin(*refused) & (~s.startswith(":") | s.rlike("^:[A-Za-z_][A-Za-z0-9_]*$"))
    return F.coalesce(path.startswith("/") & ~path.rlike(r"[?#\\\s]") & F.forall(F.split(path, "/"), segment), F.lit(False))


def normal_route(path: Column) -> Column:
    one = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(F.char_length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def joined_route(parent: Column, declared: Column, index: Column) -> Column:
    """A route's whole path under its parent's; null for one that declares none and is no index."""
    above = F.coalesce(parent, F.lit(""))
    under = F.when(above == "", normal_route(declared)).when(declared == "", above).otherwise(normal_route(F.concat(above, F.lit("/"), declared)))
    return F.when(declared.isNotNull(), F.when(declared.startswith("/"), normal_route(declared)).otherwise(under)).when(index, F.when(above == "", "/").otherwise(above))


def encoded_path(path: Column) -> Column:
    """Percent-encoded segments; letters, digits, - _ . and ~ stay."""
    out = F.url_encode(path)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(written), F.lit(wanted))
    return out


def line_of(source: Column, offset: Column) -> Column:
    """The 1-based line of a character offset."""
    return F.size(F.split(F.substring(source, F.lit(1), offset), r"\r?\n", -1))


def default_reason(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DEFAULT_REASONS.items() for x in pair]), kind), F.lit(OTHER_REASON))


def owners(frameworks: Column) -> Column:
    """The known frameworks among ``frameworks``, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(frameworks, lambda f: f.isin(*FRAMEWORKS))))


def expected_label(kind: Column, method: Column, path: Column, scheme: Column, authority: Column) -> Column:
    """The label that four kinds of node must have; null for the others."""
    return (
        F.when(kind == "http_call", F.concat(method, F.lit(" "), path))
        .when(kind == "request_payload", "Request payload")
        .when(kind == "external_service", F.concat(method, F.lit(" "), scheme, F.lit("://"), authority))
        .when(kind == "unresolved_target", "Unresolved")
    )


def minimal_event(event: Column, element: Column, modifiers: Column) -> Column:
    """The metadata kept of a UI event: kind without a leading ``on``, element, sorted distinct modifiers."""
    kind = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(event, F.lit("event")), "^on", "")), ":", ".")
    return F.struct(
        F.when(kind == "", "event").otherwise(kind).alias("event_kind"), F.lower(F.coalesce(element, F.lit("element"))).alias("element_kind"),
        F.array_sort(F.array_distinct(F.coalesce(modifiers, F.array().cast("array<string>")))).alias("modifiers"),
    )


def minimal_call(resolution: Column, path: Column, endpoint: Column, fields: Column, sensitive: Column) -> Column:
    """The metadata kept of an HTTP call, with what stands for absent values."""
    return F.struct(
        F.coalesce(resolution, F.lit("unbounded")).alias("url_resolution"), F.coalesce(path, F.lit("/{u0}")).alias("normalized_path"), F.nullif(endpoint, F.lit("")).alias("endpoint_id"),
        F.coalesce(fields, F.lit(0)).alias("query_field_count"), F.coalesce(sensitive, F.lit(False)).alias("has_sensitive_query"),
    )
