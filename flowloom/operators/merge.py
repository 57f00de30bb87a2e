"""Merging fragments and resolving calls; nothing is guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.paths import BUILT_IN_CONVERTERS


def union(*fragments: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), fragments)


def dedup_conflict(rows: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with equal ones collapsed, keys that have more than one value with their number)."""
    distinct = rows.distinct()
    conflicts = distinct.groupBy(key).count().filter("count > 1").select(key, F.col("count").alias("n_values"))
    return distinct.join(conflicts, key, "left_anti"), conflicts


def key_to_id(refs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Replace local keys in ``columns`` by ids of ``keys`` (key, id); unknown keys are ids already."""
    for i, c in enumerate(columns):
        named = keys.select(F.col("key").alias(f"__k{i}"), F.col("id").alias(f"__i{i}"))
        refs = refs.join(named, refs[c] == F.col(f"__k{i}"), "left").withColumn(c, F.coalesce(f"__i{i}", c)).drop(f"__k{i}", f"__i{i}")
    return refs


def cardinality(calls: DataFrame, targets: DataFrame, on: list[str], residual: Column | None = None) -> DataFrame:
    """Each call_id with its sorted candidate target_ids and an outcome: exact, unmatched or ambiguous.

    ``calls`` has call_id and ``on``, ``targets`` target_id and ``on``; ``residual`` may
    test the joined row. Targets are made distinct first, and candidates are counted
    where they are combined.
    """
    t = targets.toDF(*[f"t_{c}" if c in on else c for c in targets.columns])
    both = reduce(Column.__and__, [F.col(c) == F.col(f"t_{c}") for c in on])
    joined = calls.join(t, both if residual is None else both & residual, "left")
    found = joined.groupBy("call_id").agg(F.sort_array(F.collect_set("target_id")).alias("candidates"))
    n = F.size("candidates")
    return found.withColumn("outcome", F.when(n == 0, "unmatched").when(n == 1, "exact").otherwise("ambiguous"))


def resolve_literal(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls (call_id, method, path, target_repository) against targets (target_id, method, path, repository)."""
    return cardinality(calls, targets, ["method", "path"], F.col("target_repository").isNull() | (F.col("target_repository") == F.col("repository")))


def resolve_bounded(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Template calls (…, accepted array<array<string>>) against targets (…, converters array<string>).

    Every placeholder's converter must be a built-in one that the call's proof accepts.
    """
    built_in = F.array(*map(F.lit, BUILT_IN_CONVERTERS))
    fits = (F.size("accepted") == F.size("converters")) & F.forall(
        F.arrays_zip("accepted", "converters"), lambda z: F.array_contains(z["accepted"], z["converters"]) & F.array_contains(built_in, z["converters"])
    )
    return cardinality(calls, targets, ["method", "path"], fits & (F.col("target_repository").isNull() | (F.col("target_repository") == F.col("repository"))))


def payload_source(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, origin): resolution hangs off the call's payloads if it carries any, else off the call."""
    carries = edges.filter("kind = 'carries'").select(F.col("source").alias("call_id"), F.col("target").alias("payload"))
    return calls.select("call_id").join(carries, "call_id", "left").select("call_id", F.coalesce("payload", "call_id").alias("origin"))


def without_placeholders(nodes: DataFrame, edges: DataFrame, replaced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the edges in ``replaced`` (id, target), then those of their targets that no edge refers to any more."""
    kept = edges.join(replaced, "id", "left_anti")
    orphans = (
        replaced.select(F.col("target").alias("id")).distinct()
        .join(kept.select(F.col("target").alias("id")), "id", "left_anti").join(kept.select(F.col("source").alias("id")), "id", "left_anti")
    )
    return nodes.join(orphans, "id", "left_anti"), kept


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge targets that no node declares."""
    return edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def resolution_edges(found: DataFrame, bounded: bool = False) -> DataFrame:
    """Resolved calls to edges, others to diagnostics: (call_id, target_id, tier, reason, code, candidates)."""
    one = F.col("outcome") == "exact"
    tier = "dynamic_converter" if bounded else "exact_endpoint"
    return found.select(
        "call_id",
        F.when(one, F.col("candidates")[0]).alias("target_id"),
        F.when(one, tier).otherwise("unbounded").alias("tier"),
        F.when(one, tier).otherwise("dynamic_target_unproven").alias("reason"),
        F.when(F.col("outcome") == "unmatched", "url_target_unmatched").when(F.col("outcome") == "ambiguous", "url_target_ambiguous").alias("code"),
        F.when(F.col("outcome") == "ambiguous", F.col("candidates")).alias("candidate_ids"),
    )
