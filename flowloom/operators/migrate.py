"""Legacy tables to current ones: every row is migrated or quarantined with a reason, none is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.identity import edge_id, node_id, route_id
from flowloom.functions.text import timestamp_ms
from flowloom.plans.lineage import written

SOURCE = "struct<path:string,line:int,endLine:int,symbol:string>"
NODE = f"struct<id:string,kind:string,label:string,layer:string,source:{SOURCE},confidence:double>"
SNAPSHOT = f"struct<project:string,routes:array<struct<id:string,framework:string,path:string,nodeId:string>>,nodes:array<{NODE}>,edges:array<struct<id:string,source:string,target:string,kind:string,confidence:double>>>"
# The keys of a legacy snapshot.
KEYS = ("diagnostics", "edges", "nodes", "project", "routes")


def text_cell(kind: Column, data: Column) -> Column:
    """A text cell's value; null for other types and for bytes that are no UTF-8."""
    return F.when((kind == "text") & F.is_valid_utf8(data.cast("string")), data.cast("string"))


def snapshots(rows: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined) of legacy snapshots (key, payload, created_at) of ``project``.

    A payload that is no JSON object is ``invalid_payload``, a timestamp in neither accepted
    notation ``invalid_timestamp``, and a snapshot of other keys or another project, or with
    an id that its parts do not give, ``legacy_incompatible``. Ids are checked by joins over
    exploded rows of a table that is parsed once, and each check reads its own columns.
    """
    d = rows.select("key", "payload", F.from_json("payload", SNAPSHOT).alias("s"), timestamp_ms(F.col("created_at")).alias("created_at"))
    keys = F.array_sort(F.json_object_keys("payload"))
    fits = F.coalesce((keys == F.array(*map(F.lit, KEYS))) & (F.col("s.project") == project), F.lit(False))
    early = F.when(F.col("s").isNull() | keys.isNull(), "invalid_payload").when(F.col("created_at").isNull(), "invalid_timestamp").when(~fits, "legacy_incompatible")
    # what a snapshot itself decides is a short column, so the join with wrong ids takes payloads only where they are asked for
    d = written(d.withColumn("early", early))
    n = d.select("key", F.explode("s.nodes").alias("n"))
    identity = F.coalesce("n.source.symbol", "n.label")
    bad_nodes = n.filter(~F.coalesce(F.col("n.id") == node_id(F.lit(project), F.col("n.source.path"), F.col("n.kind"), identity), F.lit(False)))
    e = d.select("key", F.explode("s.edges").alias("e"))
    bad_edges = e.filter(~F.coalesce(F.col("e.id") == edge_id(F.col("e.source"), F.col("e.target"), F.col("e.kind")), F.lit(False)))
    r = d.select("key", F.explode("s.routes").alias("r"))
    expected = route_id(F.lit(project), F.col("r.framework"), F.col("r.path"), F.col("r.nodeId"))
    bad_routes = r.filter(~F.coalesce(F.col("r.id").isNull() & expected.isNotNull() | (F.col("r.id") == expected), F.lit(False)))
    lost = r.select("key", F.col("r.nodeId").alias("id")).join(n.select("key", F.col("n.id").alias("id")), ["key", "id"], "left_anti")
    wrong = bad_nodes.select("key").union(bad_edges.select("key")).union(bad_routes.select("key")).union(lost.select("key")).distinct().withColumn("wrong", F.lit(True))
    judged = d.join(wrong, "key", "left").withColumn("reason", F.coalesce("early", F.when(F.col("wrong"), "legacy_incompatible")))
    return judged.filter("reason is null").select("key", "created_at", "s"), judged.filter("reason is not null").select("key", "payload", "reason")


def converted(parsed: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, routes) of parsed snapshots in today's columns, each with its snapshot's key; the project is the only repository."""
    n = parsed.select("key", F.explode("s.nodes").alias("n"))
    nodes = n.select(
        "key", "n.id", "n.kind", F.coalesce("n.source.symbol", "n.label").alias("identity_key"), "n.label", "n.layer", F.lit(project).alias("repository"),
        F.col("n.source.path").alias("path"), "n.confidence",
    )
    edges = parsed.select("key", F.explode("s.edges").alias("e")).select("key", "e.*")
    r = parsed.select("key", F.explode("s.routes").alias("r"))
    routes = r.select("key", route_id(F.lit(project), F.col("r.framework"), F.col("r.path"), F.col("r.nodeId")).alias("id"), F.lit(project).alias("repository"), "r.framework", "r.path", F.col("r.nodeId").alias("node_id"))
    return nodes, edges, routes
