"""Fragments of analyzers assembled into one graph: local keys to ids, union, resolution of calls.

Everything is a join on ids; what has no single answer becomes an unresolved node and a diagnostic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.functions.identity import edge_id, node_id, route_id, stable_id
from flowloom.functions.paths import BUILT_IN_CONVERTERS
from flowloom.model import DIAGNOSTIC_MESSAGES, DIAGNOSTICS, EVIDENCE, LAYER_OF, Graph
from flowloom.operators.merge import cardinality, dedup_conflict, union
from flowloom.plans.lineage import written

CONVERTERS = "array<struct<name:string,kind:string,segment_index:int>>"
NODES = (
    f"id string, kind string, identity_key string, label string, layer string, repository string, path string, confidence double, evidence {EVIDENCE}, method string, "
    f"url_resolution string, normalized_path string, endpoint_id string, target_repository string, converters {CONVERTERS}, reason_code string, candidate_ids array<string>"
)
EDGES = f"id string, source string, target string, kind string, confidence double, evidence {EVIDENCE}, tier string, target_repository string"
ROUTES = "id string, repository string, framework string, path string, node_id string"
DIAGNOSTIC = "id string, code string, severity string, message string, repository string, node_id string, candidate_ids array<string>"
ADAPTER, VERSION = "flowloom.assemble", "2"


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, null where ``rows`` lacks them; others go."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def evidence(kind: Column, adapter: Column, version: Column, reason: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(kind.alias("kind"), adapter.alias("adapter"), version.alias("adapter_version"), none.alias("event_id"), reason.alias("reason"), none.alias("timestamp"))).cast(EVIDENCE)


def repeated_keys(nodes: DataFrame) -> DataFrame:
    """(id, rule) of local keys that one fragment declares more than once."""
    return nodes.groupBy("adapter", "repository", "key").count().filter("count > 1").select(F.col("key").alias("id"), F.lit("repeated_key").alias("rule"))


def canonical(nodes: DataFrame, edges: DataFrame, routes: DataFrame | None = None) -> Graph:
    """Fragments with their defaults filled in and ids instead of local keys.

    All rows have adapter, adapter_version and repository; nodes key, kind and path, edges
    source, target and kind, routes key, framework and path. Optional: symbol, identity,
    label, layer, evidence_kind, reason, confidence and the columns of ``NODES`` and ``EDGES``.
    A reference that is no key of its fragment is taken for an id.
    """
    optional = lambda rows, c, otherwise: F.coalesce(F.col(c), otherwise) if c in rows.columns else otherwise
    none = F.lit(None).cast("string")

    def common(rows: DataFrame) -> dict[str, Column]:
        proof = evidence(optional(rows, "evidence_kind", F.lit("inferred")), F.col("adapter"), F.col("adapter_version"), optional(rows, "reason", none))
        return {"confidence": optional(rows, "confidence", F.lit(0.5)), "evidence": proof}

    n = nodes.withColumn("identity_key", optional(nodes, "identity", optional(nodes, "symbol", F.col("key"))))
    n = n.withColumns(common(nodes) | {
        "id": node_id(F.col("repository"), F.col("path"), F.col("kind"), F.col("identity_key")),
        "label": optional(nodes, "label", F.col("identity_key")), "layer": optional(nodes, "layer", mapped(LAYER_OF, F.col("kind"))),
    })
    keys = n.select("adapter", "repository", "key", "id").distinct()

    def named(rows: DataFrame, c: str) -> DataFrame:
        ids = keys.select("adapter", "repository", F.col("key").alias(c), F.col("id").alias("__id"))
        return rows.join(ids, ["adapter", "repository", c], "left").withColumn(c, F.coalesce("__id", c)).drop("__id")

    e = named(named(edges.withColumns(common(edges)), "source"), "target").withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("kind")))
    if routes is not None:
        r = named(routes, "key").withColumnRenamed("key", "node_id")
        routes = shaped(r.withColumn("id", route_id(F.col("repository"), F.col("framework"), F.col("path"), F.col("node_id"))), ROUTES)
    return Graph(shaped(n, NODES), shaped(e, EDGES), routes)


def diagnostic(code: Column, repository: Column, node: Column, candidates: Column) -> list[Column]:
    """The columns of ``DIAGNOSTIC``; absent references are null in the identity as well."""
    severity, message = mapped(DIAGNOSTICS, code), mapped(DIAGNOSTIC_MESSAGES, code)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    null = F.lit("null")
    key = stable_id("d_", quoted(code), quoted(severity), quoted(message), quoted(repository), null, quoted(node), null, F.coalesce(F.to_json(candidates), null), null, ascii_only=True)
    return [key.alias("id"), code.alias("code"), severity.alias("severity"), message.alias("message"), repository.alias("repository"), node.alias("node_id"), candidates.alias("candidate_ids")]


def endpoint(method: Column, path: Column, repository: Column) -> Column:
    return F.concat(method, F.lit(" "), F.coalesce(F.concat(repository, F.lit(":")), F.lit("")), path)


def candidates(nodes: DataFrame, proofs: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(call_id, candidates (id, repository, confidence), outcome, tier) of the calls that may be resolved.

    Literal calls need an endpoint that agrees with their method, path and repository;
    calls by a bounded template take part if they have no endpoint yet, by the path and the
    placeholders (segment_index, accepted_converters) of ``proofs`` (call_id, normalized_path,
    placeholders). Equality on method and path drives both joins.
    """
    active = namespaces.select(F.col("namespace").alias("repository")).distinct()
    verb = F.substring_index("endpoint_id", " ", 1)
    targets = nodes.filter((F.col("kind") == "django_url_pattern") & (F.col("endpoint_id") == F.concat(verb, F.lit(" "), "normalized_path"))).join(active, "repository", "left_semi")
    targets = targets.select(F.struct("id", "repository", "confidence").alias("target_id"), "repository", verb.alias("method"), F.col("normalized_path").alias("path"), F.col("converters").alias("given"))

    calls = nodes.filter("kind = 'http_call'").select(F.col("id").alias("call_id"), "url_resolution", "method", F.col("normalized_path").alias("path"), "endpoint_id", "target_repository")
    literal = calls.filter("url_resolution = 'literal' and endpoint_id is not null")
    bounded = calls.filter("url_resolution = 'bounded_template' and endpoint_id is null").drop("path")
    bounded = bounded.join(proofs.select("call_id", F.col("normalized_path").alias("path"), "placeholders"), "call_id", "left")

    there = F.col("target_repository").isNull() | (F.col("target_repository") == F.col("repository"))
    agrees = F.col("endpoint_id") == endpoint(F.col("method"), F.col("path"), F.col("target_repository"))
    places = F.transform("given", lambda c: c["segment_index"])
    fits = (
        (F.size("given") == F.size("placeholders")) & (F.size(F.array_distinct(places)) == F.size("given"))
        & F.forall("placeholders", lambda p: F.exists("given", lambda c: (c["segment_index"] == p["segment_index"]) & c["kind"].isin(*BUILT_IN_CONVERTERS) & F.array_contains(p["accepted_converters"], c["kind"])))
    )
    return union(
        cardinality(literal, targets, ["method", "path"], there & agrees).withColumn("tier", F.lit("exact_endpoint")),
        cardinality(bounded, targets, ["method", "path"], there & fits).withColumn("tier", F.lit("dynamic_converter")),
    )


def resolved(nodes: DataFrame, edges: DataFrame, proofs: DataFrame, namespaces: DataFrame) -> Graph:
    """``nodes`` and ``edges`` with every call that may be resolved bound to its only target or to an unresolved node.

    The resolution hangs off the call's payloads if it carries any. Edges to earlier
    placeholders are replaced, placeholders that nothing refers to any more go.
    """
    found = written(candidates(nodes, proofs, namespaces))
    one = F.col("outcome") == "exact"
    call = nodes.filter("kind = 'http_call'").select(F.col("id").alias("call_id"), "repository", "path", "method", "normalized_path", F.col("confidence").alias("call_confidence"))
    reason = F.when(F.col("outcome") == "unmatched", "url_target_unmatched").when(F.col("outcome") == "ambiguous", "url_target_ambiguous")
    groups = F.regexp_replace(F.substring("call_id", 3, 64), "(.{4})(?=.)", "$1:")
    d = found.join(call, "call_id").withColumn("reason_code", reason).withColumn("identity_key", F.when(~one, F.concat(F.lit("unresolved:"), groups, F.lit(":"), "reason_code")))
    missed = node_id(F.col("repository"), F.col("path"), F.lit("unresolved_target"), F.col("identity_key"), ascii_only=True)
    hit = F.when(one, F.col("candidates")[0])
    d = written(d.select(
        "call_id", "outcome", "tier", "repository", "path", "method", "normalized_path", "call_confidence", "reason_code", "identity_key",
        F.when(one, hit["id"]).otherwise(missed).alias("target"), hit["repository"].alias("hit_repository"), F.when(one, hit["confidence"]).otherwise(F.col("call_confidence")).alias("target_confidence"),
        F.when(F.col("outcome") == "ambiguous", F.transform("candidates", lambda c: c["id"])).alias("candidate_ids"),
    ))

    payloads = nodes.filter("kind = 'request_payload'").select(F.col("id").alias("target"), F.col("confidence").alias("payload_confidence"))
    carried = edges.filter("kind = 'carries'").join(payloads, "target").select(F.col("source").alias("call_id"), F.col("target").alias("payload"), "payload_confidence")
    hung = d.join(carried, "call_id", "left").withColumn("source", F.coalesce("payload", "call_id"))
    tier, why = F.when(one, F.col("tier")).otherwise("unbounded"), F.when(one, F.col("tier")).otherwise("dynamic_target_unproven")
    new = written(shaped(hung.select(
        edge_id(F.col("source"), F.col("target"), F.lit("resolves_to")).alias("id"), "source", "target", F.lit("resolves_to").alias("kind"),
        F.least(F.coalesce("payload_confidence", "call_confidence"), "target_confidence").alias("confidence"),
        evidence(F.when(one, "inferred").otherwise("unresolved"), F.lit(ADAPTER), F.lit(VERSION), why).alias("evidence"), tier.alias("tier"), F.col("hit_repository").alias("target_repository"),
    ), EDGES))

    open_nodes = nodes.filter("kind = 'unresolved_target'").select(F.col("id").alias("target"))
    stale = written(edges.filter("kind = 'resolves_to'").join(new.select("source").distinct(), "source", "left_semi").join(open_nodes, "target", "left_semi").select("id", "target"))
    edges = written(edges.join(stale.select("id").union(new.select("id")), "id", "left_anti").unionByName(new))
    orphans = stale.select("target").distinct().join(edges.select("target"), "target", "left_anti").select(F.col("target").alias("id"))

    unresolved = shaped(d.filter("outcome <> 'exact'").select(
        F.col("target").alias("id"), F.lit("unresolved_target").alias("kind"), "identity_key", F.lit("Unresolved").alias("label"), F.lit("unresolved").alias("layer"), "repository", "path",
        F.col("call_confidence").alias("confidence"), evidence(F.lit("unresolved"), F.lit(ADAPTER), F.lit(VERSION), F.col("reason_code")).alias("evidence"), "reason_code", "candidate_ids",
    ), NODES)
    bound = F.col("outcome").isNotNull() & (F.col("outcome") == "exact") & (F.col("tier") == "dynamic_converter")
    update = d.select(F.col("call_id").alias("id"), "outcome", "tier", "hit_repository", endpoint(F.col("method"), F.col("normalized_path"), F.col("hit_repository")).alias("bound_endpoint"))
    kept = nodes.join(orphans.union(unresolved.select("id")), "id", "left_anti").join(update, "id", "left").withColumns({
        "endpoint_id": F.when(bound, F.col("bound_endpoint")).when(F.col("outcome").isin("unmatched", "ambiguous"), F.lit(None)).otherwise(F.col("endpoint_id")),
        "target_repository": F.when(bound, F.col("hit_repository")).otherwise(F.col("target_repository")),
    })
    diagnostics = d.filter("outcome <> 'exact'").select(*diagnostic(F.col("reason_code"), F.col("repository"), F.col("call_id"), F.col("candidate_ids")))
    return Graph(shaped(kept, NODES).unionByName(unresolved), edges, None, diagnostics)


def merged(graphs: list[Graph], proofs: DataFrame, namespaces: DataFrame) -> tuple[Graph, DataFrame]:
    """(the graphs as one with its calls resolved, conflicts (id, rule)); equal rows collapse, an id of two values is a conflict and left out."""
    together = lambda part, schema: dedup_conflict(union(*[shaped(p, schema) for g in graphs if (p := getattr(g, part)) is not None]))
    parts = {"nodes": NODES, "edges": EDGES} | ({"routes": ROUTES} if any(g.routes is not None for g in graphs) else {})
    rows, conflicts = {}, []
    for part, schema in parts.items():
        kept, broken = together(part, schema)
        rows[part] = written(kept)
        conflicts.append(broken.select("id", F.lit(f"{part}_conflict").alias("rule")))
    out = resolved(rows["nodes"], rows["edges"], proofs, namespaces)
    known = [g.diagnostics for g in graphs if g.diagnostics is not None]
    diagnostics = union(*[shaped(p, DIAGNOSTIC) for p in [*known, out.diagnostics]]).distinct()
    return Graph(out.nodes, out.edges, rows.get("routes"), diagnostics), reduce(DataFrame.union, conflicts)
