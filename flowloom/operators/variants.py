"""Strict shapes of JSON texts: what is unknown, missing or of another type, named by its path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.plans.lineage import written

#: For an object by its place, such as ``$.nodes[*]``: its keys and their types; a type that ends in ? may be absent, one of ``any`` may hold anything.
Shape = dict[str, dict[str, str]]


def _kind(value: str) -> Column:
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean")
        .when(told == "VOID", "null").when(told.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").otherwise("other")
    )


def json_faults(rows: DataFrame, shape: Shape, most_levels: int = 64) -> DataFrame:
    """(id, path, rule) of JSON texts (id, text) that are not of ``shape``.

    Rules: ``broken`` (no JSON, or a key twice), ``unknown_key``, ``missing_key``, ``wrong_type``,
    ``too_deep``. Elements of a list have the type that the shape gives its place followed by ``[*]``; an object whose place
    the shape leaves out may hold anything, as may a value of type any. Values are
    exploded level by level without leaving generated code, and only those that the shape
    goes into go on. A null text is broken; a null value is of type null, which no other type takes.
    """
    spark = rows.sparkSession
    known = [(place, key, kind.rstrip("?"), kind.endswith("?")) for place, keys in shape.items() for key, kind in keys.items()]
    known = spark.createDataFrame(known, "place string, key string, want string, may_lack boolean")
    placed = spark.createDataFrame([(p,) for p in shape], "place string")
    parsed = written(rows.select("id", F.try_parse_json(F.col("text").cast("string")).alias("value")))
    faults = [parsed.filter("value is null").select("id", F.lit("$").alias("path"), F.lit("broken").alias("rule"))]
    level = parsed.filter("value is not null").select("id", F.lit("$").alias("path"), F.lit("$").alias("place"), "value", F.lit("object" if "$" in shape else "any").alias("want"))
    for _ in range(most_levels):
        level = written(level.withColumn("kind", _kind("value")))
        if level.isEmpty():
            break
        wrong = (F.col("want") != "any") & (F.col("kind") != F.col("want"))
        faults.append(level.filter(wrong).select("id", "path", F.lit("wrong_type")))
        inside = level.filter(~wrong & F.col("kind").isin("object", "array")).withColumn("nth", F.monotonically_increasing_id())
        inside = written(inside)
        inside.createOrReplaceTempView("__variant_level")
        children = spark.sql("SELECT l.id, l.path, l.place, l.kind, l.nth, c.pos, c.key, c.value FROM __variant_level l, LATERAL variant_explode(l.value) c")
        spark.catalog.dropTempView("__variant_level")
        of_lists = children.filter("kind = 'array'").select("id", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path"), F.concat("place", F.lit("[*]")).alias("place"), "value")
        stated = known.filter("key = ''").select("place", F.col("want").alias("want"))
        of_lists = of_lists.join(placed.withColumn("shaped", F.lit(True)), "place", "left").join(F.broadcast(stated), "place", "left")
        of_lists = of_lists.select("id", "path", "place", "value", F.coalesce("want", F.when(F.col("shaped"), "object"), F.lit("any")).alias("want"))
        members = children.filter("kind = 'object'").join(placed, "place").join(known, ["place", "key"], "left")
        path, place = (F.concat(c, F.lit("."), "key") for c in ("path", "place"))
        members = written(members.select("id", "nth", "key", path.alias("path"), place.alias("place"), "value", "want"))
        faults.append(members.filter("want is null").select("id", "path", F.lit("unknown_key")))
        wanted = inside.filter("kind = 'object'").select("id", "nth", "path", "place").join(known.filter("not may_lack and key <> ''"), "place")
        faults.append(wanted.join(members.select("nth", "key"), ["nth", "key"], "left_anti").select("id", F.concat("path", F.lit("."), "key"), F.lit("missing_key")))
        level = members.filter("want is not null").select("id", "path", "place", "value", "want").union(of_lists)
    else:
        faults.append(level.select("id", "path", F.lit("too_deep")))
    return reduce(DataFrame.union, faults)


_EVIDENCE = {"kind": "string", "adapter": "string", "adapterVersion": "string", "reason": "string?", "eventId": "string?", "timestamp": "string?"}
_SOURCE = {"repository": "string", "path": "string", "line": "number?", "endLine": "number?", "symbol": "string?"}
_COMMON = {"id": "string", "kind": "string", "evidence": "array", "confidence": "number", "metadata": "any"}
# The keys of a snapshot on the wire.
SNAPSHOT: Shape = {
    "$": {"schemaVersion": "number", "project": "string", "repositorySetId": "string", "repositories": "array", "routes": "array", "nodes": "array", "edges": "array", "diagnostics": "array"},
    "$.repositories[*]": {"namespace": "string"},
    "$.routes[*]": {"id": "string", "repository": "string", "framework": "string", "path": "string", "nodeId": "string"},
    "$.nodes[*]": _COMMON | {"identityKey": "string", "label": "string", "layer": "string", "source": "object"},
    "$.nodes[*].source": _SOURCE,
    "$.nodes[*].evidence[*]": _EVIDENCE,
    "$.edges[*]": _COMMON | {"source": "string", "target": "string"},
    "$.edges[*].evidence[*]": _EVIDENCE,
    "$.diagnostics[*]": {"id": "string", "code": "string", "severity": "string", "message": "string", "repository": "string?", "source": "object?", "nodeId": "string?", "edgeId": "string?", "candidateIds": "array?", "eventId": "string?"},
    "$.diagnostics[*].source": _SOURCE,
    "$.diagnostics[*].candidateIds[*]": {"": "string"},
}
