"""Schemas and closed vocabularies of the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Node kinds with the layer they default to, edge kinds with their legal ends, diagnostics.
LAYER_OF = {
    "frontend_route": "frontend", "page": "frontend", "component": "frontend", "ui_event": "frontend", "function": "backend",
    "http_call": "http", "request_payload": "http", "django_url_pattern": "backend", "django_view": "backend", "model": "data",
    "query_boundary": "data", "external_service": "external", "unresolved_target": "unresolved",
}
LAYERS = ("frontend", "http", "backend", "data", "external", "unresolved")
LEGAL_ENDS = {
    "renders": (
        ("frontend_route", "page"),
        ("frontend_route", "component"),
        ("page", "component"),
        ("component", "component"),
    ),
    "contains": (
        ("page", "ui_event"),
        ("component", "ui_event"),
        ("page", "function"),
        ("component", "function"),
    ),
    "handles": (
        ("ui_event", "function"),
        ("ui_event", "unresolved_target"),
    ),
    "navigates_to": (
        ("page", "frontend_route"),
        ("component", "frontend_route"),
        ("function", "frontend_route"),
        ("page", "unresolved_target"),
        ("component", "unresolved_target"),
        ("function", "unresolved_target"),
    ),
    "calls": (
        ("page", "http_call"),
        ("component", "http_call"),
        ("function", "http_call"),
        ("page", "function"),
        ("component", "function"),
        ("function", "function"),
        ("django_view", "function"),
        ("function", "external_service"),
        ("django_view", "external_service"),
        ("page", "unresolved_target"),
        ("component", "unresolved_target"),
        ("function", "unresolved_target"),
        ("django_view", "unresolved_target"),
    ),
    "carries": (
        ("http_call", "request_payload"),
    ),
    "resolves_to": (
        ("http_call", "django_url_pattern"),
        ("http_call", "external_service"),
        ("http_call", "unresolved_target"),
        ("request_payload", "django_url_pattern"),
        ("request_payload", "external_service"),
        ("request_payload", "unresolved_target"),
        ("django_url_pattern", "django_view"),
        ("django_url_pattern", "unresolved_target"),
    ),
    "invokes": (
        ("django_view", "function"),
        ("function", "function"),
        ("django_view", "unresolved_target"),
        ("function", "unresolved_target"),
    ),
    "accesses": (
        ("django_view", "query_boundary"),
        ("function", "query_boundary"),
        ("query_boundary", "model"),
        ("query_boundary", "unresolved_target"),
    ),
    "branches_to": (
        ("page", "unresolved_target"),
        ("component", "unresolved_target"),
        ("function", "unresolved_target"),
        ("django_view", "unresolved_target"),
    ),
}
DIAGNOSTICS = {
    "frontend_analyzer_unavailable": "warning", "frontend_analyzer_failed": "error", "frontend_analyzer_invalid_output": "error", "source_read_failed": "warning",
    "unsupported_syntax": "warning", "unresolved_dynamic_target": "warning", "unresolved_referenced_target": "warning", "unresolved_django_url": "warning",
    "python_import_module_unresolved": "warning", "python_import_module_ambiguous": "warning", "bounded_url_proof_invalid": "error", "url_target_unmatched": "warning",
    "url_target_ambiguous": "warning", "runtime_capture_empty": "info", "runtime_event_unmatched": "warning", "runtime_event_ambiguous": "warning", "runtime_identity_conflict": "warning",
}
# What the diagnostics say.
DIAGNOSTIC_MESSAGES = {
    "frontend_analyzer_unavailable": "Frontend analyzer is unavailable.",
    "frontend_analyzer_failed": "Frontend analyzer failed.",
    "frontend_analyzer_invalid_output": "Frontend analyzer returned invalid output.",
    "source_read_failed": "A source file could not be read.",
    "unsupported_syntax": "Unsupported syntax was left unresolved.",
    "unresolved_dynamic_target": "A dynamic target could not be proven.",
    "unresolved_referenced_target": "A referenced target was not declared in the analyzed graph.",
    "unresolved_django_url": "A Django URL declaration could not be resolved statically.",
    "python_import_module_unresolved": "A Python import module could not be proven.",
    "python_import_module_ambiguous": "A Python import module has multiple valid candidates.",
    "bounded_url_proof_invalid": "A bounded URL proof was invalid.",
    "url_target_unmatched": "No unique Django URL target matched the request shape.",
    "url_target_ambiguous": "Multiple Django URL targets matched the request shape.",
    "runtime_capture_empty": "The selected runtime capture contains no events.",
    "runtime_event_unmatched": "The runtime event did not match one canonical flow.",
    "runtime_event_ambiguous": "The runtime event matched multiple canonical flows.",
    "runtime_identity_conflict": "The runtime event identities do not describe one canonical flow.",
}

SOURCE = "struct<repository:string,path:string,line:int,end_line:int,symbol:string>"
EVIDENCE = "array<struct<kind:string,adapter:string,adapter_version:string,event_id:string,reason:string,timestamp:string>>"


def legal_ends(spark: SparkSession) -> DataFrame:
    """(kind, source_kind, target_kind), 50 rows."""
    rows = [(kind, *pair) for kind, pairs in LEGAL_ENDS.items() for pair in pairs]
    return spark.createDataFrame(rows, "kind string, source_kind string, target_kind string")


def diagnostic_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIAGNOSTICS.items()), "code string, severity string")


@dataclass
class Graph:
    """A snapshot as DataFrames: nodes (id, kind, layer, label, ...), edges (id, source, target, kind, ...)."""

    nodes: DataFrame
    edges: DataFrame
    routes: DataFrame | None = None
    diagnostics: DataFrame | None = None
