"""Contract rules of single nodes, routes and runtime events: metadata by kind, path grammar, references."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from flowloom.functions.identity import route_id
from flowloom.functions.paths import decoded, endpoint_id, is_strict_endpoint, strip_base
from flowloom.operators.contract import METHOD, OPERATIONS, implies
from flowloom.operators.validate import violations

# Frameworks, closed sets and forms of metadata, fields of each kind (the mandatory ones, then the others).
FRAMEWORKS = ("django", "nuxt", "react", "vue")
FRONTEND = ("nuxt", "react", "vue")
PAYLOAD_KINDS = ("body", "form", "query")
BODY_SHAPES = ("none", "object", "array", "scalar", "unknown")
TIERS = ("exact_endpoint", "declared_path", "configured_base", "dynamic_converter", "external_boundary", "unbounded")
UNRESOLVED_REASONS = ("dynamic_target_unproven", "referenced_target_missing", "python_module_unproven", "python_module_ambiguous", "url_target_unmatched", "url_target_ambiguous", "unsupported_syntax")
TOKEN = r"^[A-Za-z][A-Za-z0-9_.-]{0,63}\z"
NAMESPACE = r"^[a-z][a-z0-9._-]{0,63}\z"
QUALIFIED = r"^(?=.{3,512}\z)[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\z"
CAPTURE = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")
SENSITIVE_TRACE = r"(?i)token|cookie|password|secret|credential|private[_-]?key|session|request[_-]?body"
TRACE_MEMBER = r"^[a-z0-9][a-z0-9_*/-]{0,255}=[\x20-\x2b\x2d-\x3c\x3e-\x7e]{1,256}\z"
PLACEHOLDER = r"^\{[pu]([0-9]|[12][0-9]|3[01])\}\z"
FIELDS = {
    "frontend_route": (("framework", "declared_path"), ()),
    "page": (("framework_owners",), ()),
    "component": (("framework_owners",), ()),
    "ui_event": (("framework_owners", "event_kind", "element_kind", "modifiers"), ()),
    "function": ((), ("framework_owners", "python_qualified_name")),
    "http_call": (("method", "url_resolution", "normalized_path", "query_field_count", "has_sensitive_query"), ("endpoint_id", "target_repository")),
    "request_payload": (("payload_kinds", "body_shape", "body_field_count", "query_field_count", "has_sensitive_fields"), ()),
    "django_url_pattern": (("declared_path", "normalized_path", "endpoint_id", "converters"), ()),
    "django_view": ((), ("python_qualified_name",)),
    "model": ((), ("python_qualified_name",)),
    "query_boundary": (("operation",), ("model_qualified_name",)),
    "external_service": (("method", "scheme", "host", "path_present", "query_field_count", "has_sensitive_query", "boundary_only"), ("port",)),
    "unresolved_target": (("reason_code",), ("candidate_ids",)),
}
#: Characters that a canonical path leaves as they are.
PLAIN = string.ascii_letters + string.digits + "!$&'()*+,;=:@-._~"
_ESCAPED_PLAIN = "%(?:" + "|".join(f"{ord(c):02X}" for c in PLAIN) + ")"


def is_contract_path(path: Column, placeholders: str | None = None) -> Column:
    """Origin-form in canonical escapes, without empty inner, dot or blank segments, placeholders numbered from 0.

    ``placeholders``: literal (none), bounded (only {p0}, ...), unbounded (only {u0}, ...) or None for any.
    """
    segments = F.split(F.substring(path, 2, 2048), "/")
    held = F.filter(segments, lambda s: s.rlike(PLACEHOLDER))
    plain = F.filter(segments, lambda s: (s != "") & ~s.rlike(PLACEHOLDER))

    def fine(s: Column) -> Column:
        text = decoded(s)
        return (
            ~s.isin(".", "..") & s.rlike(r"^[A-Za-z0-9%!$&'()*+,;=:._~-]*\z") & ~s.rlike("%(?![0-9A-F]{2})") & ~s.rlike(_ESCAPED_PLAIN) & text.isNotNull()
            & (~text.contains("�") | s.contains("%EF%BF%BD")) & ~text.rlike(r"[\p{Z}\s\x00-\x1f\x7f-\x9f/\\]|%2[fF]|%5[cC]") & ~F.regexp_replace(text, "%2[eE]", ".").isin(".", "..")
        )

    numbers = F.transform(held, lambda s: F.regexp_extract(s, r"[0-9]+", 0).cast("int"))
    in_order = F.forall(F.transform(numbers, lambda n, i: n == i), lambda ok: ok)
    ok = F.char_length(path).between(1, 2048) & path.startswith("/") & ~path.contains("//") & F.forall(plain, fine) & in_order
    only = lambda letter: (F.size(held) > 0) & F.forall(held, lambda s: s.startswith("{" + letter))
    more = {None: F.lit(True), "literal": F.size(held) == 0, "bounded": only("p"), "unbounded": only("u")}[placeholders]
    return F.coalesce(ok & more, F.lit(False))


def is_declared_path(path: Column, framework: Column) -> Column:
    """A path whose segments may be :name outside of Django and <converter:name> in it."""
    django = framework == "django"
    name = "[A-Za-z_][A-Za-z0-9_]{0,63}"
    segments = F.split(F.substring(path, 2, 2048), "/")
    fine = F.forall(segments, lambda s: F.when(s.startswith(":"), ~django & s.rlike(rf"^:{name}\z")).when(s.startswith("<"), django & s.rlike(rf"^<(?:{name}:)?{name}>\z")).otherwise(True))
    plain = F.regexp_replace(path, r"/(?::[A-Za-z_][A-Za-z0-9_]*|<(?:[A-Za-z_][A-Za-z0-9_]*:)?[A-Za-z_][A-Za-z0-9_]*>)", "/segment")
    return F.coalesce(framework.isin(*FRAMEWORKS) & fine & is_contract_path(plain), F.lit(False))


def sorted_set(values: Column, allowed: tuple[str, ...] | None, least: int, most: int) -> Column:
    """``least`` to ``most`` distinct values in order, all of ``allowed``."""
    ok = F.size(values).between(least, most) & (values == F.array_sort(F.array_distinct(values)))
    return ok if allowed is None else ok & F.forall(values, lambda v: v.isin(*allowed))


def metadata_violations(nodes: DataFrame) -> DataFrame:
    """(id, rule) of nodes whose metadata columns do not fit their kind; columns that ``nodes`` lacks are null.

    Hosts of external services and converters of url patterns have rules of their own in ``contract``.
    """
    kind = F.col("kind")
    names = dict.fromkeys(f for needed, free in FIELDS.values() for f in (*needed, *free))
    c = {f: F.col(f) if f in nodes.columns else F.lit(None) for f in names}
    text = {f: v.cast("string") for f, v in c.items() if f not in ("framework_owners", "modifiers", "payload_kinds", "converters", "candidate_ids")}
    lists = {f: c[f].cast("array<string>") for f in ("framework_owners", "modifiers", "payload_kinds", "candidate_ids")}
    needed = F.lit(True)
    unknown = F.lit(True)
    for k, (must, may) in FIELDS.items():
        needed = F.when(kind == k, _all(c[f].isNotNull() for f in must)).otherwise(needed)
        unknown = F.when(kind == k, _all(c[f].isNull() for f in names if f not in (*must, *may))).otherwise(unknown)
    of = lambda *kinds: kind.isin(*kinds)
    given = lambda f: c[f].isNotNull()
    layer, counts = F.col("layer"), ("query_field_count", "body_field_count")
    path = text["normalized_path"]
    shaped = F.when(text["url_resolution"] == "literal", is_contract_path(path, "literal")).when(text["url_resolution"] == "bounded_template", is_contract_path(path, "bounded"))
    rules = {
        "fields_missing": needed, "fields_unknown": unknown,
        "framework_owners": implies(given("framework_owners"), sorted_set(lists["framework_owners"], FRONTEND, 1, 3)),
        "function_owners": implies(of("function"), given("framework_owners") == (layer == "frontend")),
        "declared_path": implies(of("frontend_route", "django_url_pattern"), is_declared_path(text["declared_path"], F.when(of("frontend_route"), text["framework"]).otherwise("django"))),
        "event_tokens": implies(of("ui_event"), text["event_kind"].rlike(TOKEN) & text["element_kind"].rlike(TOKEN)),
        "modifiers": implies(of("ui_event"), sorted_set(lists["modifiers"], None, 0, 16) & F.forall(lists["modifiers"], lambda m: m.rlike(TOKEN))),
        "method": implies(of("http_call", "external_service"), text["method"].rlike(METHOD)),
        "call_path": implies(of("http_call"), shaped.when(text["url_resolution"] == "unbounded", is_contract_path(path, "unbounded"))),
        "call_endpoint": implies(of("http_call") & (text["url_resolution"] == "unbounded"), ~given("endpoint_id")),
        "endpoint_length": implies(given("endpoint_id"), F.char_length(text["endpoint_id"]).between(3, 2300)),
        "target_repository": implies(given("target_repository"), text["target_repository"].rlike(NAMESPACE)),
        "counts": _all(implies(given(f), c[f].cast("long").between(0, 1000)) for f in counts),
        "payload_kinds": implies(of("request_payload"), sorted_set(lists["payload_kinds"], PAYLOAD_KINDS, 1, 3)),
        "body_shape": implies(of("request_payload"), text["body_shape"].isin(*BODY_SHAPES)),
        "pattern_path": implies(of("django_url_pattern"), is_contract_path(path)),
        "qualified_name": _all(implies(given(f), text[f].rlike(QUALIFIED)) for f in ("python_qualified_name", "model_qualified_name")),
        "operation": implies(of("query_boundary"), text["operation"].isin(*OPERATIONS)),
        "scheme": implies(of("external_service"), text["scheme"].isin("http", "https")),
        "port": implies(given("port"), c["port"].cast("long").between(1, 65535)),
        "boundary_only": implies(of("external_service"), c["boundary_only"].cast("boolean")),
        "reason_code": implies(of("unresolved_target"), text["reason_code"].isin(*UNRESOLVED_REASONS)),
        "candidate_ids": implies(given("candidate_ids"), sorted_set(lists["candidate_ids"], None, 1, 100) & F.forall(lists["candidate_ids"], lambda i: i.rlike(r"^n_[0-9a-f]{64}\z"))),
    }
    return violations(nodes, rules)


def _all(conditions) -> Column:
    out = F.lit(True)
    for ok in conditions:
        out = out & ok
    return out


def edge_metadata_violations(edges: DataFrame) -> DataFrame:
    """``edges``: id, kind, tier, target_repository, payload_kinds; only resolutions have the first two, only carried payloads the last."""
    resolves, carries = F.col("kind") == "resolves_to", F.col("kind") == "carries"
    rules = {
        "tier": F.when(resolves, F.col("tier").isin(*TIERS)).otherwise(F.col("tier").isNull()),
        "target_repository": implies(F.col("target_repository").isNotNull(), resolves & F.col("target_repository").rlike(NAMESPACE)),
        "payload_kinds": implies(F.col("payload_kinds").isNotNull(), carries & sorted_set(F.col("payload_kinds"), PAYLOAD_KINDS, 1, 3)),
    }
    return violations(edges, rules)


def route_violations(routes: DataFrame, nodes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(id, rule) of routes (id, repository, framework, path, node_id) against nodes (id, kind, repository) and the manifest."""
    known = namespaces.select(F.col("namespace").alias("repository")).distinct().withColumn("known", F.lit(True))
    held = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), F.col("repository").alias("node_repository"))
    rules = {
        "repository": F.col("known"),
        "framework": F.col("framework").isin(*FRAMEWORKS),
        "path": is_contract_path(F.col("path")),
        "node": F.col("node_kind").isNotNull(),
        "node_kind": F.col("node_kind") == F.when(F.col("framework") == "django", "django_url_pattern").otherwise("frontend_route"),
        "node_repository": F.col("node_repository") == F.col("repository"),
        "id": F.col("id") == route_id(F.col("repository"), F.col("framework"), F.col("path"), F.col("node_id")),
    }
    repeated = routes.groupBy("repository", "framework", "path").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate").alias("rule"))
    return violations(routes.join(held, "node_id", "left").join(known, "repository", "left"), rules).union(repeated)


EVENT = {"capture_id": "string", "method": "string", "path": "string", "target": "string", "endpoint_id": "string", "view_qualified_name": "string", "status": "int", "duration_ms": "double", "traceparent": "string", "tracestate": "string"}


def normalized_events(events: DataFrame) -> DataFrame:
    """Events with the canonical columns and ``legacy``: older ones name run_id, view and trace (traceparent, tracestate) instead."""
    has = lambda c: c in events.columns
    none = F.lit(None).cast("string")
    old = {"capture_id": F.col("run_id") if has("run_id") else none, "view_qualified_name": F.col("view") if has("view") else none}
    old |= {f: F.col(f"trace.{f}") if has("trace") else none for f in ("traceparent", "tracestate")}
    columns = [F.coalesce(old.get(f, none).cast(t), (F.col(f) if has(f) else none).cast(t)).alias(f) for f, t in EVENT.items()]
    legacy = F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in ("run_id", "view", "trace") if has(f)], F.lit(False))
    return events.select(*[c for c in events.columns if c not in EVENT and c not in ("run_id", "view", "trace")], *columns, legacy.alias("legacy"))


def _loopback(hosts: pd.Series) -> pd.Series:
    import ipaddress

    def ok(host: str | None) -> bool:
        try:
            return host == "localhost" or ipaddress.ip_address(host).is_loopback
        except ValueError:
            return False

    return hosts.map(ok)


def is_trace(parent: Column) -> Column:
    return parent.rlike(r"^00-(?!0{32})[0-9a-f]{32}-(?!0{16})[0-9a-f]{16}-[0-9a-f]{2}\z")


def target_path(target: Column) -> Column:
    """The path of an HTTP URL to this machine without query or fragment, / if it has none; null for others."""
    form = r"^https?://(\[[^\]/]*\]|[^/:@\[\]]+)(:[0-9]+)?(/.*)?\z"
    host = F.regexp_replace(F.lower(F.regexp_extract(target, form, 1)), r"[\[\]]", "")
    path = F.regexp_extract(target, form, 3)
    ok = target.rlike(form) & ~target.rlike(r"[?#\x00-\x1f\x7f]") & F.pandas_udf(_loopback, BooleanType())(host)
    return F.when(ok, F.when(path == "", "/").otherwise(path))


def is_trace_state(state: Column) -> Column:
    """At most 32 members key=value, without tenants and without what looks sensitive."""
    members = F.split(state, ",")
    return F.char_length(state).between(1, 512) & ~state.rlike(r"[\r\n@]") & ~state.rlike(SENSITIVE_TRACE) & (F.size(members) <= 32) & F.forall(members, lambda m: m.rlike(TRACE_MEMBER))


def event_violations(events: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """(id, rule) of normalized events, whose id is ``event_id``; optional fields may be null.

    The endpoint is the method and the path without the longest of ``bases``.
    """
    c = {f: F.col(f) for f in EVENT}
    given = lambda f, ok: implies(c[f].isNotNull(), ok)
    path, stripped = c["path"], lambda p: strip_base(p, bases or [])
    strict = lambda p: F.char_length(p).between(1, 2048) & is_strict_endpoint(p) & ~p.contains("//") & ~p.rlike("(?i)%(2f|5c)")
    at = target_path(c["target"])
    rules = {
        "capture_id": c["capture_id"].rlike(CAPTURE),
        "method": c["method"].isin(*METHODS),
        "path": strict(path),
        "target": given("target", (F.char_length(c["target"]) <= 2048) & strict(at) & (stripped(at) == path)),
        "endpoint_id": given("endpoint_id", c["endpoint_id"] == endpoint_id(c["method"], stripped(path))),
        "view_qualified_name": given("view_qualified_name", c["view_qualified_name"].rlike(QUALIFIED)),
        "status": given("status", c["status"].between(100, 599)),
        "duration_ms": given("duration_ms", c["duration_ms"].between(0, 86_400_000) & ~F.isnan(c["duration_ms"])),
        "traceparent": given("traceparent", is_trace(c["traceparent"])),
        "tracestate": given("tracestate", c["traceparent"].isNotNull() & is_trace_state(c["tracestate"])),
    }
    return violations(events.withColumn("id", F.col("event_id")), rules)
