"""The graph contract as a table of violations (id, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.frontend import expected_label
from flowloom.functions.identity import edge_id, node_id
from flowloom.functions.paths import is_repo_path
from flowloom.functions.text import is_secret_value
from flowloom.model import DIAGNOSTICS, LAYER_OF, legal_ends

# Forms of a repository's name and of a dotted symbol.
NAMESPACE = r"^[a-z][a-z0-9._-]{0,63}$"
DOTTED = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for each rule that a row breaks; a rule is what must hold, and null is a breach."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), rule) for rule, ok in rules.items()]), lambda r: r.isNotNull())
    return rows.select("id", F.explode(broken).alias("rule"))


# Reasons of evidence by its kind.
REASONS = {
    "inferred": (
        "ast_route_declaration", "ast_symbol_declaration", "ast_call", "ast_handler_binding", "ast_import_binding", "literal_url", "finite_url_domain", "request_payload_shape", "django_url_declaration",
        "django_view_binding", "django_query_call", "external_boundary", "exact_endpoint", "declared_path", "configured_base", "dynamic_converter",
    ),
    "unresolved": (
        "dynamic_target_unproven", "referenced_target_missing", "python_module_unproven", "python_module_ambiguous", "url_target_unmatched", "url_target_ambiguous", "unsupported_syntax",
    ),
    "observed": ("runtime_coherent_endpoint", "runtime_coherent_view", "runtime_coherent_resolution"),
}


def node_violations(nodes: DataFrame) -> DataFrame:
    """Kind, layer and, where the columns are there, the id from its parts, the label and the evidence."""
    layers = F.create_map(*[F.lit(x) for pair in LAYER_OF.items() for x in pair])
    rules = {
        "kind": F.col("kind").isin(*LAYER_OF),
        "layer": (F.col("layer") == F.try_element_at(layers, F.col("kind"))) | ((F.col("kind") == "function") & (F.col("layer") == "frontend")),
    }
    if {"repository", "path", "identity_key"} <= set(nodes.columns):
        rules["id"] = F.col("id") == node_id(F.col("repository"), F.col("path"), F.col("kind"), F.col("identity_key"))
    if "label" in nodes.columns:
        rules["label"] = ~is_secret_value(F.col("label"), generic=False)
    if {"label", "method", "normalized_path"} <= set(nodes.columns):
        none = F.lit(None).cast("string")  # the authority of an external service is no column of nodes
        rules["label_form"] = F.coalesce(F.col("label") == expected_label(F.col("kind"), F.col("method"), F.col("normalized_path"), none, none), F.lit(True))
    if "evidence" in nodes.columns:
        rules |= evidence_rules(F.col("evidence"))
    return violations(nodes, rules)


def evidence_rules(evidence: Column) -> dict[str, Column]:
    """1 to 32 items, sorted and distinct, event fields exactly on observed ones, reasons of the catalogue of their kind."""
    reasons = F.create_map(*[x for kind, known in REASONS.items() for x in (F.lit(kind), F.array(*map(F.lit, known)))])
    return {
        "evidence_reason": F.forall(evidence, lambda e: e["reason"].isNull() | F.coalesce(F.array_contains(F.try_element_at(reasons, e["kind"]), e["reason"]), F.lit(False))),
        "evidence_size": F.size(evidence).between(1, 32),
        "evidence_order": evidence == F.array_sort(F.array_distinct(evidence)),
        "evidence_event": F.forall(evidence, lambda e: (e["kind"] == "observed") == (e["event_id"].isNotNull() & e["timestamp"].isNotNull())),
    }


def edge_violations(edges: DataFrame) -> DataFrame:
    return violations(edges, {"self_loop": F.col("source") != F.col("target"), "id": F.col("id") == edge_id(F.col("source"), F.col("target"), F.col("kind"))})


def diagnostic_violations(diagnostics: DataFrame) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for pair in DIAGNOSTICS.items() for x in pair])
    return violations(diagnostics, {"code": F.col("code").isin(*DIAGNOSTICS), "severity": F.col("severity") == F.try_element_at(severity, F.col("code"))})


def source_violations(sources: DataFrame) -> DataFrame:
    """Sources of diagnostics (id, repository, path, line, end_line, symbol): namespace, path, lines in order, dotted symbol, no secrets."""
    line = lambda c: F.col(c).isNull() | F.col(c).between(1, 10_000_000)
    return violations(sources, {
        "repository": F.col("repository").rlike(NAMESPACE), "path": is_repo_path(F.col("path")), "line": line("line"), "end_line": line("end_line"),
        "line_order": F.col("line").isNull() | F.col("end_line").isNull() | (F.col("end_line") >= F.col("line")),
        "symbol": F.col("symbol").isNull() | (F.col("symbol").rlike(DOTTED) & (F.char_length("symbol") <= 512)),
        "secret": ~F.exists(F.array("repository", "path", F.coalesce("symbol", F.lit(""))), lambda v: is_secret_value(v)),
    })


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with source_kind and target_kind, null for ends that no node declares."""
    s, t = nodes.select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    return edges.join(s, "source", "left").join(t, "target", "left")


def illegal_edges(nodes: DataFrame, edges: DataFrame, legal: DataFrame | None = None) -> DataFrame:
    """Edges whose kind and end kinds are in no legal triple (``legal``: the 50 of the contract unless given)."""
    legal = legal_ends(edges.sparkSession) if legal is None else legal
    return ends(nodes, edges).filter("source_kind is not null and target_kind is not null").join(legal, ["kind", "source_kind", "target_kind"], "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, end) of edges whose source or target no node declares."""
    parts = [edges.select("id", F.lit(end).alias("end"), F.col(end).alias("ref")) for end in ("source", "target")]
    return reduce(DataFrame.union, parts).join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "end")


def degree_violations(nodes: DataFrame, edges: DataFrame, kind: str, edge_kind: str, incoming: bool, least: int = 1, most: int = 1) -> DataFrame:
    """(id, degree) of nodes of ``kind`` without ``least`` to ``most`` edges of ``edge_kind`` on that side."""
    side = "target" if incoming else "source"
    n = edges.filter(F.col("kind") == edge_kind).groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    counted = nodes.filter(F.col("kind") == kind).select("id").join(n, "id", "left").fillna(0, ["degree"])
    return counted.filter(~F.col("degree").between(least, most))


def strict(found: DataFrame) -> None:
    """Fail closed: raise if there is any violation."""
    if first := found.first():
        raise ValueError(f"graph contract violated: {first.asDict()}")
