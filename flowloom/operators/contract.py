"""The parts of the graph contract that span metadata, converters, proofs and resolutions.

As in ``validate``, a rule is what must hold, breaches are rows (id, rule), and null is a breach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import is_external_host
from flowloom.functions.paths import BUILT_IN_CONVERTERS, django_route
from flowloom.operators.validate import violations

# Forms of methods and converter names, query operations, limits.
METHOD = r"^[A-Z][A-Z0-9!#$%&'*+.^_`|~-]{0,31}\z"
CONVERTER_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,63}\z"
OPERATIONS = ("all", "filter", "get", "create", "update", "delete", "aggregate", "other")
MOST_PLACEHOLDERS, MOST_MEMBERS, MOST_COMBINATIONS, MOST_PROOF_BYTES = 32, 256, 4096, 8192


def implies(condition: Column, ok: Column) -> Column:
    return F.when(condition, F.coalesce(ok, F.lit(False))).otherwise(True)


def _segments(path: Column) -> Column:
    return F.split(F.substring(path, F.lit(2), F.char_length(path)), "/")


def _placed(path: Column, pattern: str) -> Column:
    """Segments of ``path`` that match, each with its index."""
    return F.filter(F.transform(_segments(path), lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: x["s"].rlike(pattern))


def converter_rules(declared: Column, normalized: Column, converters: Column) -> dict[str, Column]:
    """``converters`` (name, kind, segment_index) are those that ``declared`` names, in order; ``normalized`` has {p0}, {p1}, ... in their place."""
    inner = lambda x: F.regexp_extract(x["s"], "^<(.*)>$", 1)
    kind = lambda x: F.when(inner(x).contains(":"), F.substring_index(inner(x), ":", 1)).otherwise("str")
    want = F.transform(
        _placed(declared, "^<"),
        lambda x: F.struct(
            F.regexp_replace(inner(x), "^[^:]*:", "").alias("name"),
            F.when(kind(x).isin(*BUILT_IN_CONVERTERS, "path"), kind(x)).otherwise("custom").alias("kind"),
            x["at"].cast("int").alias("segment_index"),
        ),
    )
    got = F.transform(converters, lambda c: F.struct(c["name"].alias("name"), c["kind"].alias("kind"), c["segment_index"].cast("int").alias("segment_index")))
    names = F.transform(converters, lambda c: c["name"])
    return {
        "converter_count": F.size(converters).between(0, MOST_PLACEHOLDERS),
        "converter_names": (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(names, lambda n: n.rlike(CONVERTER_NAME)),
        "converters": got == want,
        "normalized_path": normalized == django_route(F.lit(""), declared)[1],
    }


def url_pattern_violations(patterns: DataFrame) -> DataFrame:
    """``patterns``: id, declared_path, normalized_path, endpoint_id, converters."""
    method, path = F.substring_index("endpoint_id", " ", 1), F.regexp_extract("endpoint_id", "^[^ ]* (.*)$", 1)
    rules = converter_rules(F.col("declared_path"), F.col("normalized_path"), F.col("converters"))
    return violations(patterns, rules | {"endpoint": method.rlike(METHOD) & (path == F.col("normalized_path"))})


def call_violations(calls: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``calls``: id, method, normalized_path, endpoint_id, target_repository; a given endpoint agrees with the rest, a given repository is in ``namespaces``."""
    known = namespaces.select(F.col("namespace").alias("target_repository")).distinct().withColumn("known", F.lit(True))
    prefix = F.coalesce(F.concat("target_repository", F.lit(":")), F.lit(""))
    rules = {
        "method": F.col("method").rlike(METHOD),
        "endpoint": implies(F.col("endpoint_id").isNotNull(), F.col("endpoint_id") == F.concat("method", F.lit(" "), prefix, "normalized_path")),
        "target_repository": implies(F.col("target_repository").isNotNull(), F.col("known")),
    }
    return violations(calls.join(known, "target_repository", "left"), rules)


def external_violations(services: DataFrame) -> DataFrame:
    """``services``: id, method, scheme, host, port, query_field_count, path_present, has_sensitive_query, boundary_only."""
    rules = {
        "method": F.col("method").rlike(METHOD),
        "scheme": F.col("scheme").isin("http", "https"),
        "host": is_external_host(F.col("host")),
        "port": implies(F.col("port").isNotNull(), F.col("port").between(1, 65535)),
        "query_field_count": F.col("query_field_count").between(0, 1000),
        "flags": F.col("path_present").isNotNull() & F.col("has_sensitive_query").isNotNull() & F.col("boundary_only"),
    }
    return violations(services, rules)


def query_violations(queries: DataFrame) -> DataFrame:
    return violations(queries, {"operation": F.col("operation").isin(*OPERATIONS)})


def proof_violations(proofs: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call by a bounded template has one proof, and each proof such a call.

    ``proofs``: call_id, version, normalized_path, placeholders (token, segment_index,
    member_count, accepted_converters); ``calls``: id, url_resolution, normalized_path. The
    id of a breach is the call's; proofs without a call id are breaches of a null id.
    """
    counted = proofs.groupBy("call_id").agg(F.count("*").alias("n_proofs"))
    bounded = calls.filter("url_resolution = 'bounded_template'").select(F.col("id").alias("call_id"), F.col("normalized_path").alias("call_path"))
    lonely = bounded.join(counted, "call_id", "left_anti").select(F.col("call_id").alias("id"), F.lit("missing").alias("rule"))
    repeated = counted.filter("n_proofs > 1").select(F.col("call_id").alias("id"), F.lit("duplicate").alias("rule"))

    holders, path = F.col("placeholders"), F.col("normalized_path")
    want = F.transform(_placed(path, r"^\{p([0-9]|[12][0-9]|3[01])\}\z"), lambda x: F.struct(F.regexp_replace(x["s"], r"[{}]", "").alias("token"), x["at"].cast("int").alias("at")))
    got = F.transform(holders, lambda h: F.struct(h["token"].alias("token"), h["segment_index"].cast("int").alias("at")))
    accepted = lambda h: h["accepted_converters"]
    wire = F.struct(
        F.col("version").alias("version"), F.col("call_id").alias("callKey"), path.alias("normalizedPath"),
        F.transform(holders, lambda h: F.struct(h["token"].alias("token"), h["segment_index"].alias("segmentIndex"), h["member_count"].alias("memberCount"), accepted(h).alias("acceptedConverters"))).alias("placeholders"),
    )
    rules = {
        "version": F.col("version") == 1,
        "call": path == F.col("call_path"),
        "placeholder_count": F.size(holders).between(1, MOST_PLACEHOLDERS),
        "placeholders": (got == want) & ~path.contains("{u") & F.forall(F.transform(want, lambda w, i: w["token"] == F.concat(F.lit("p"), i.cast("string"))), lambda ok: ok),
        "member_count": F.forall(holders, lambda h: h["member_count"].between(1, MOST_MEMBERS)),
        "accepted": F.forall(holders, lambda h: (F.size(accepted(h)) > 0) & (accepted(h) == F.array_sort(F.array_distinct(accepted(h)))) & F.forall(accepted(h), lambda c: c.isin(*BUILT_IN_CONVERTERS))),
        "combinations": F.aggregate(holders, F.lit(1.0), lambda n, h: n * h["member_count"]) <= MOST_COMBINATIONS,
        "bytes": F.octet_length(F.to_json(wire)) <= MOST_PROOF_BYTES,
    }
    return violations(proofs.join(bounded, "call_id", "left").withColumn("id", F.col("call_id")), rules).union(repeated).union(lonely)


CALL = ("method", "url_resolution", "normalized_path", "endpoint_id", "target_repository", "converters")


def resolution_violations(nodes: DataFrame, edges: DataFrame, fragment: bool = False) -> DataFrame:
    """(id, rule) of ``resolves_to`` edges that their tier, owner, call and target do not allow.

    ``nodes``: id, kind, repository, method, url_resolution, normalized_path, endpoint_id,
    target_repository, converters; ``edges``: id, source, target, kind, tier,
    target_repository. An edge of a payload is judged by the only call that carries it. In a
    ``fragment`` literal calls may keep the endpoint that a later merge resolves.
    """
    side = lambda name, on: nodes.select(F.col("id").alias(on), F.struct("kind", "repository", *CALL).alias(name))
    carried = edges.filter("kind = 'carries'").groupBy(F.col("target").alias("source")).agg(F.count("*").alias("n_carries"), F.min("source").alias("carrier"))
    found = edges.filter("kind = 'resolves_to'").withColumnRenamed("target_repository", "repository").join(side("to", "target"), "target", "left").join(side("owner", "source"), "source", "left")
    payload = F.col("owner.kind") == "request_payload"
    found = found.join(carried, "source", "left").withColumn("call_id", F.when(~payload, F.col("source")).when(F.col("n_carries") == 1, F.col("carrier")))
    found = found.join(side("call", "call_id"), "call_id", "left")

    tier, to, call, repository = (F.col(c) for c in ("tier", "to", "call", "repository"))
    pattern = F.coalesce(F.col("owner.kind") == "django_url_pattern", F.lit(False))
    called = ~pattern & F.coalesce(call["kind"] == "http_call", F.lit(False))
    unbounded = called & F.coalesce(call["url_resolution"] == "unbounded", F.lit(False))
    missed, bound = to["kind"] == "unresolved_target", call["url_resolution"] == "bounded_template"
    rest = called & ~unbounded
    hit, external = rest & (to["kind"] == "django_url_pattern"), rest & (to["kind"] == "external_service")
    method = F.substring_index(to["endpoint_id"], " ", 1)
    prefix = F.coalesce(F.concat(call["target_repository"], F.lit(":")), F.lit(""))
    placed = F.forall(F.transform(to["converters"], lambda c, i: c["kind"].isin(*BUILT_IN_CONVERTERS) & (F.get(_segments(to["normalized_path"]), c["segment_index"]) == F.concat(F.lit("{p"), i.cast("string"), F.lit("}")))), lambda ok: ok)
    rules = {
        "owner": pattern | called,
        "pattern": implies(pattern, ((tier == "declared_path") & (to["kind"] == "django_view")) | ((tier == "unbounded") & missed)),
        "repository": implies(repository.isNotNull(), ~missed & (repository == to["repository"])),
        "unbounded": implies(unbounded, (tier == "unbounded") & missed & call["endpoint_id"].isNull() & call["target_repository"].isNull() & repository.isNull()),
        "unresolved": implies(rest & missed, (tier == "unbounded") & repository.isNull() & (call["endpoint_id"].isNull() | (F.lit(fragment) & (call["url_resolution"] == "literal")))),
        "external": implies(external, (call["url_resolution"] == "literal") & (tier == "external_boundary")),
        "target": implies(rest, to["kind"].isin("unresolved_target", "external_service", "django_url_pattern")),
        "call_repository": implies(hit & call["target_repository"].isNotNull(), call["target_repository"] == to["repository"]),
        "bounded": implies(hit & bound, (tier == "dynamic_converter") & (call["target_repository"] == to["repository"]) & (repository == to["repository"])
            & (call["endpoint_id"] == F.concat(call["method"], F.lit(" "), to["repository"], F.lit(":"), to["normalized_path"]))
            & (call["method"] == method) & (call["normalized_path"] == to["normalized_path"]) & placed),
        "literal_tier": implies(hit & ~bound, tier.isin("exact_endpoint", "configured_base")),
        "literal_method": implies(hit & ~bound, call["method"] == method),
        "literal_path": implies(hit & ~bound & (tier == "exact_endpoint"), call["normalized_path"] == to["normalized_path"]),
        "literal_endpoint": implies(hit & ~bound & call["endpoint_id"].isNotNull(), call["endpoint_id"] == F.concat(method, F.lit(" "), prefix, F.substring_index(to["endpoint_id"], " ", -1))),
    }
    return violations(found, rules)
