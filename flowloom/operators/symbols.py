"""Names with one value: URL constants to a fixpoint, object shapes, shapes that calls hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.fixpoint import spread
from flowloom.plans.lineage import written


def url_constants(declarations: DataFrame) -> DataFrame:
    """(name, url) of the names whose declarations give exactly one URL.

    ``declarations``: name, ref (a name that the value starts with, or null), text (what
    follows it); those without a name are left out. Each round joins all declarations with
    the constants of the round before, until none changes; a chain of n references takes n
    rounds. A value without a slash is no URL. A name that has two values in some round is
    no constant from then on, nor is what refers to it, so circles settle as well: a name
    gains a value, changes it as often as a name before it does, or leaves for good.
    """
    spark = declarations.sparkSession
    declared = written(declarations.filter("name is not null").select("name", "ref", "text").distinct())
    known = spark.createDataFrame([], "name string, url string")
    several = spark.createDataFrame([], "name string")
    while True:
        values = declared.join(known.select(F.col("name").alias("ref"), F.col("url").alias("base")), "ref", "left")
        url = F.when(F.col("ref").isNull(), F.col("text")).otherwise(F.concat("base", F.coalesce("text", F.lit(""))))
        found = values.select("name", url.alias("url")).filter(F.col("url").contains("/")).join(several, "name", "left_anti")
        least = written(found.groupBy("name").agg(F.min("url").alias("url"), F.max("url").alias("other")))
        now = least.filter("url = other").select("name", "url")
        changed = now.join(known.withColumnRenamed("url", "before"), "name", "full_outer").filter(~F.col("url").eqNullSafe(F.col("before")))
        if changed.isEmpty():
            return now
        known, several = now, written(several.union(least.filter("url <> other").select("name")))


def payload_shapes(fields: DataFrame) -> DataFrame:
    """(name, fields) of the names whose object shapes all fit into their largest one.

    ``fields``: name, shape (one object literal), ordinal, field, type. A literal's fields are
    one row of it, bounded by its source text; equal shapes collapse before they are compared.
    The largest shape has most fields; of several the first in order of their fields stays.
    """
    shapes = fields.groupBy("name", "shape").agg(F.array_sort(F.collect_list(F.struct("ordinal", "field", "type"))).alias("f"))
    shapes = shapes.select("name", F.transform("f", lambda x: F.struct(x["field"].alias("field"), x["type"].alias("type"))).alias("fields")).distinct()
    largest = shapes.groupBy("name").agg(F.min(F.struct((-F.size("fields")).alias("n"), "fields")).alias("l")).select("name", F.col("l.fields").alias("largest"))
    names = lambda c: F.transform(c, lambda x: x["field"])
    misfits = shapes.join(largest, "name").filter(F.size(F.array_except(names("fields"), names("largest"))) > 0).select("name").distinct()
    return largest.join(misfits, "name", "left_anti").withColumnRenamed("largest", "fields")


def payload_hints(functions: DataFrame, parameters: DataFrame, arguments: DataFrame, named: DataFrame) -> DataFrame:
    """(fn, parameter, fields) of the parameters that calls give exactly one shape.

    ``functions`` (fn, name), ``parameters`` (fn, index, parameter), ``arguments`` (callee,
    owner, index, root, fields): an argument of a call to the name ``callee`` within the function
    ``owner`` (null outside of all), either of literal ``fields`` or the variable ``root``;
    ``named`` (name, fields) are the shapes of variables, as ``payload_shapes`` gives them.
    A call counts if its name has one function. An argument that is a parameter of its owner
    hands on that parameter's shapes, through any chain of calls. Of a parameter's shapes the
    least and the greatest are kept, which tells one from several; only parameters whose shapes
    changed are joined again.
    """
    single = functions.groupBy("name").agg(F.count("*").alias("n"), F.min("fn").alias("fn")).filter("n = 1").select(F.col("name").alias("callee"), "fn")
    given = arguments.join(single, "callee").join(parameters, ["fn", "index"]).select("fn", "parameter", "owner", "root", "fields")
    own = parameters.select(F.col("fn").alias("owner"), F.col("parameter").alias("root"), F.lit(True).alias("is_parameter"))
    given = written(given.join(own, ["owner", "root"], "left"))
    handed = written(given.filter("fields is null and is_parameter").select("owner", "root", "fn", "parameter").distinct())
    known = given.filter("fields is null and is_parameter is null").drop("fields").join(named.select(F.col("name").alias("root"), "fields"), "root")
    stated = given.filter("fields is not null").select("fn", "parameter", "fields").union(known.select("fn", "parameter", "fields")).filter(F.size("fields") > 0)

    def further(changed: DataFrame) -> DataFrame:
        return changed.withColumnsRenamed({"fn": "owner", "parameter": "root"}).join(handed, ["owner", "root"])

    start = stated.select("fn", "parameter", F.col("fields").alias("least"), F.col("fields").alias("most"))
    found = spread(start, further, ["fn", "parameter"], {"least": F.min, "most": F.max})
    return found.filter("least = most").select("fn", "parameter", F.col("least").alias("fields"))


def request_payloads(parts: DataFrame, parameters: DataFrame, hints: DataFrame, named: DataFrame, deletions: DataFrame) -> DataFrame:
    """``parts`` (part, owner, root, fields, at) with what is known of their fields: those of a parameter's hint, of a literal or of a named shape.

    Fields that the owner deletes from the variable before ``at`` (``deletions``: owner, root, field, at) are left out; unknown ones are empty.
    """
    own = parameters.select(F.col("fn").alias("owner"), F.col("parameter").alias("root"), F.lit(True).alias("is_parameter"))
    hinted = hints.select(F.col("fn").alias("owner"), F.col("parameter").alias("root"), F.col("fields").alias("hint"))
    shapes = named.select(F.col("name").alias("root"), F.col("fields").alias("shape"))
    gone = deletions.withColumnRenamed("at", "deleted_at").join(parts.select("part", "owner", "root", "at"), ["owner", "root"]).filter("deleted_at < at").groupBy("part").agg(F.collect_set("field").alias("gone"))
    rows = parts.join(own, ["owner", "root"], "left").join(hinted, ["owner", "root"], "left").join(shapes, "root", "left").join(gone, "part", "left")
    fields = F.when(F.col("is_parameter"), F.col("hint")).otherwise(F.coalesce("fields", "shape"))
    kept = F.filter(fields, lambda f: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), f["name"]))
    return rows.select("part", F.coalesce(kept, F.array().cast(parts.schema["fields"].dataType)).alias("fields"))
