"""Guidance for diagnostics and unresolved evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import kind_words

# Title and guidance of each diagnostic code and of each reason of unresolved evidence.
FOR_DIAGNOSTICS = {
    "frontend_analyzer_unavailable": ("Frontend analyzer unavailable", "Check the local analyzer setup for this repository, then run a static analysis again."),
    "frontend_analyzer_failed": ("Frontend analyzer failed", "Check the local frontend analyzer output, fix the unsupported project issue, then run a static analysis again."),
    "frontend_analyzer_invalid_output": ("Invalid frontend analyzer output", "Inspect the analyzer contract for this repository and rerun static analysis after the output is valid."),
    "source_read_failed": ("Source file unreadable", "Check that the local source file is readable from the configured repository root, then refresh the static snapshot."),
    "unsupported_syntax": ("Unsupported syntax", "Inspect the selected unresolved source area and add a supported static pattern or fixture coverage."),
    "unresolved_dynamic_target": ("Dynamic target unproven", "Inspect the dynamic target and add a statically provable route, call, or unresolved boundary."),
    "unresolved_referenced_target": ("Referenced target missing", "Check the referenced declaration and make the target visible to the local static analyzer."),
    "unresolved_django_url": ("Django URL unresolved", "Check the Django URL declaration shape and keep unsupported patterns represented as unresolved."),
    "python_import_module_unresolved": ("Python module unresolved", "Check the static Python import root proof so the module can be resolved without importing code."),
    "python_import_module_ambiguous": ("Python module ambiguous", "Reduce the static import candidates until one local module can be proven."),
    "bounded_url_proof_invalid": ("Bounded URL proof invalid", "Check the bounded URL proof inputs and rerun analysis after the proof is contract-valid."),
    "url_target_unmatched": ("URL target unmatched", "Inspect the request shape and Django URL declarations so the request remains unresolved or has one exact target."),
    "url_target_ambiguous": ("URL target ambiguous", "Inspect the visible candidate targets and adjust the route proof so exactly one target remains."),
    "runtime_capture_empty": ("Runtime capture empty", "Use a capture ID that has local runtime receipt events, or analyze without a capture for the static graph."),
    "runtime_event_unmatched": ("Runtime event unmatched", "Inspect the static endpoint and view identities; unmatched runtime events remain transient diagnostics only."),
    "runtime_event_ambiguous": ("Runtime event ambiguous", "Inspect the visible static candidates; ambiguous runtime events remain transient diagnostics only."),
    "runtime_identity_conflict": ("Runtime identity conflict", "Check that the runtime endpoint and view identities describe one canonical static flow."),
}
FOR_UNRESOLVED = {
    "dynamic_target_unproven": ("Dynamic target unproven", "Inspect this unresolved target and keep it unresolved until a static target proof exists."),
    "referenced_target_missing": ("Referenced target missing", "Check the local declaration that should provide this target and rerun static analysis."),
    "python_module_unproven": ("Python module unproven", "Check the static import-root proof without importing Django code."),
    "python_module_ambiguous": ("Python module ambiguous", "Narrow the local import candidates until one module is statically proven."),
    "url_target_unmatched": ("URL target unmatched", "Compare the request shape with visible Django URL patterns and leave it unresolved until one target proves."),
    "url_target_ambiguous": ("URL target ambiguous", "Inspect the visible candidates and remove the ambiguity in the static URL proof."),
    "unsupported_syntax": ("Unsupported syntax", "Keep the unsupported construct unresolved or replace it with a supported static pattern."),
}


def _guidance(spark, texts: dict[str, tuple[str, str]], key: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in texts.items()], f"{key} string, title string, guidance string"))


def diagnostic_cards(diagnostics: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, source, title, guidance, focus_type, focus_id) of diagnostics (id, code, node_id, edge_id, candidate_ids).

    The focus is the least candidate among the visible ``nodes``; a diagnostic without one
    points at its own node, else at its own edge, if that one is visible.
    """
    shown = nodes.select(F.col("id").alias("focus_id")).distinct()
    tried = diagnostics.select("id", F.explode("candidate_ids").alias("focus_id")).join(shown, "focus_id", "left_semi")
    best = tried.groupBy("id").agg(F.min("focus_id").alias("candidate"))
    d = diagnostics.join(best, "id", "left").join(_guidance(diagnostics.sparkSession, FOR_DIAGNOSTICS, "code"), "code")
    node = F.coalesce("candidate", "node_id")
    d = d.withColumn("focus_id", F.coalesce(node, "edge_id")).withColumn("focus_type", F.when(node.isNotNull(), "node").when(F.col("edge_id").isNotNull(), "edge"))
    visible = shown.withColumn("focus_type", F.lit("node")).union(edges.select(F.col("id").alias("focus_id")).distinct().withColumn("focus_type", F.lit("edge"))).withColumn("seen", F.lit(True))
    d = d.join(visible, ["focus_id", "focus_type"], "left")
    return d.select(
        F.concat(F.lit("diagnostic:"), "id").alias("key"), F.concat(F.lit("Diagnostic: "), kind_words(F.col("code"))).alias("source"), "title", "guidance",
        F.when(F.col("seen"), F.col("focus_type")).alias("focus_type"), F.when(F.col("seen"), F.col("focus_id")).alias("focus_id"),
    )


def evidence_cards(items: DataFrame, owner_type: str) -> DataFrame:
    """The same columns for the unresolved evidence of nodes or edges (id, evidence); they have no focus."""
    found = items.select("id", F.explode("evidence").alias("e")).filter("e.kind = 'unresolved'").select("id", F.col("e.reason").alias("reason"))
    none = F.lit(None).cast("string")
    return found.join(_guidance(items.sparkSession, FOR_UNRESOLVED, "reason"), "reason").select(
        F.concat_ws(":", F.lit("evidence"), F.lit(owner_type), "id", "reason").alias("key"), F.concat(F.lit("Evidence: "), kind_words(F.col("reason"))).alias("source"),
        "title", "guidance", none.alias("focus_type"), none.alias("focus_id"),
    )
