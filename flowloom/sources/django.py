"""URLs and HTTP methods of Django projects, by joins over the facts of ``files.python_facts``.

Names are resolved by equality of module and symbol; what has no single definition stays
unresolved. ``modules`` (module, path) gives the dotted names of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.paths import django_route
from flowloom.plans.joins import shuffled
from flowloom.plans.lineage import written

# Methods of generic views, of view sets and of their actions.
GENERIC_METHODS = {
    "ListAPIView": ("GET",),
    "CreateAPIView": ("POST",),
    "ListCreateAPIView": ("GET", "POST"),
    "RetrieveAPIView": ("GET",),
    "RetrieveUpdateAPIView": ("GET", "PUT", "PATCH"),
    "RetrieveDestroyAPIView": ("GET", "DELETE"),
    "RetrieveUpdateDestroyAPIView": ("GET", "PUT", "PATCH", "DELETE"),
    "UpdateAPIView": ("PUT", "PATCH"),
    "DestroyAPIView": ("DELETE",),
    "ListView": ("GET",),
    "DetailView": ("GET",),
    "TemplateView": ("GET",),
    "RedirectView": ("GET",),
    "FormView": ("GET", "POST"),
    "CreateView": ("GET", "POST"),
    "UpdateView": ("GET", "POST"),
    "DeleteView": ("GET", "POST"),
}
VIEWSET_METHODS = {
    "ModelViewSet": {"collection": ("GET", "POST"), "detail": ("GET", "PUT", "PATCH", "DELETE")},
    "ReadOnlyModelViewSet": {"collection": ("GET",), "detail": ("GET",)},
}
ACTION_METHODS = {
    "list": ("collection", "GET"), "create": ("collection", "POST"), "retrieve": ("detail", "GET"),
    "update": ("detail", "PUT"), "partial_update": ("detail", "PATCH"), "destroy": ("detail", "DELETE"),
}
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _definitions(facts: DataFrame) -> DataFrame:
    return facts.filter("kind in ('class', 'model', 'function')")


def bindings(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, name, module, symbol) of imports, relative ones counted from the file's own package."""
    own = modules.select("path", F.split("module", r"\.").alias("own"))
    i = facts.filter("kind = 'import'").select("path", "name", "target").join(own, "path", "left")
    level, rest = F.length(F.regexp_extract("target", r"^(\.*)", 1)), F.regexp_replace("target", r"^\.+", "")
    stated, symbol = F.substring_index(rest, ":", 1), F.when(rest.contains(":"), F.substring_index(rest, ":", -1))
    kept = F.size("own") - level + F.col("path").rlike(r"(^|/)__init__\.py$").cast("int")
    package = F.array_join(F.slice("own", F.lit(1), F.greatest(kept, F.lit(0))), ".")
    module = F.when(level == 0, stated).when(kept >= 0, F.array_join(F.filter(F.array(package, stated), lambda x: x != ""), "."))
    return i.select("path", "name", module.alias("module"), symbol.alias("symbol"))


def resolved(refs: DataFrame, facts: DataFrame, modules: DataFrame) -> DataFrame:
    """``refs`` (path, expression) with def_path and def_name of their only definition, null for none or several.

    A definition in the file itself comes first, then what its imports bind.
    """
    wanted = refs.select("path", "expression").distinct()
    defs = _definitions(facts).select(F.col("path").alias("def_path"), F.col("name").alias("def_name")).distinct()
    local = wanted.join(defs, (F.col("path") == F.col("def_path")) & (F.col("expression") == F.col("def_name")))
    head, tail = F.substring_index("expression", ".", 1), F.regexp_extract("expression", r"^[^.]*\.(.*)$", 1)
    bound = wanted.withColumns({"name": head, "tail": tail}).join(bindings(facts, modules), ["path", "name"])
    dotted = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ".")
    symbol = F.coalesce("symbol", F.lit(""))
    options = F.array(F.struct(F.col("module").alias("m"), dotted(symbol, F.col("tail")).alias("s")), F.struct(dotted(F.col("module"), symbol).alias("m"), F.col("tail").alias("s")))
    tried = bound.select("path", "expression", F.explode(F.array_distinct(options)).alias("o")).select("path", "expression", F.col("o.m").alias("module"), F.col("o.s").alias("def_name"))
    there = tried.join(modules.select("module", F.col("path").alias("def_path")), "module").join(defs, ["def_path", "def_name"]).select("path", "expression", "def_path", "def_name")
    imported = there.join(local.select("path", "expression"), ["path", "expression"], "left_anti")
    found = local.select("path", "expression", "def_path", "def_name").union(imported).distinct().groupBy("path", "expression")
    only = found.agg(F.count("*").alias("n"), F.min("def_path").alias("def_path"), F.min("def_name").alias("def_name")).filter("n = 1").drop("n")
    return refs.join(only, ["path", "expression"], "left")


def view_methods(facts: DataFrame) -> DataFrame:
    """(def_path, def_name, role, method) of functions and classes; role is view, collection or detail. What has no row answers GET as a view."""
    spark = facts.sparkSession
    d = facts.filter("kind = 'decorator'").withColumn("short", _last(F.col("name")))
    named = F.when(F.col("short").isin("api_view", "require_http_methods"), F.from_json(F.get_json_object("target", "$.args"), "array<string>"))
    named = named.when(F.col("short") == "require_GET", F.array(F.lit("GET"))).when(F.col("short") == "require_POST", F.array(F.lit("POST"))).when(F.col("short") == "require_safe", F.array(F.lit("GET"), F.lit("HEAD")))
    functions = facts.filter("kind = 'function'").select("path", F.col("name").alias("parent"))
    decorated = d.join(shuffled(functions), ["path", "parent"], "left_semi").select(F.col("path").alias("def_path"), F.col("parent").alias("def_name"), F.lit("view").alias("role"), F.explode(named).alias("method"))

    classes = facts.filter("kind in ('class', 'model')").select(F.col("path").alias("def_path"), F.col("name").alias("def_name"), F.posexplode_outer(F.split("target", ",")).alias("at", "base")).withColumn("base", _last(F.trim("base")))
    rows = [(b, "view", m) for b, m in GENERIC_METHODS.items()] + [(b, r, m) for b, roles in VIEWSET_METHODS.items() for r, m in roles.items()]
    known = F.broadcast(spark.createDataFrame(rows, "base string, role string, methods array<string>"))
    inherited = classes.join(known, "base").groupBy("def_path", "def_name", "role").agg(F.min_by("methods", "at").alias("methods"))
    own = facts.filter("kind = 'function' and parent is not null").select(F.col("path").alias("def_path"), F.col("parent").alias("def_name"), _last(F.col("name")).alias("child"))
    actions = F.broadcast(spark.createDataFrame([(a, r, m) for a, (r, m) in ACTION_METHODS.items()] + [(m, "view", m.upper()) for m in HTTP_METHODS], "child string, role string, method string"))
    members = own.join(shuffled(classes.select("def_path", "def_name").distinct()), ["def_path", "def_name"], "left_semi").join(actions, "child").join(shuffled(inherited), ["def_path", "def_name", "role"], "left_anti")
    stated = inherited.select("def_path", "def_name", "role", F.explode("methods").alias("method"))
    return decorated.union(stated).union(members.select(*decorated.columns)).withColumn("method", F.upper("method")).distinct()


def viewset_actions(facts: DataFrame) -> DataFrame:
    """(def_path, def_name, role, action, method) of methods decorated as actions with a literal detail flag and methods."""
    d = facts.filter("kind = 'decorator' and target is not null").filter(_last(F.col("name")) == "action")
    j = lambda field: F.get_json_object("target", f"$.{field}")
    role = F.when(j("detail") == "true", "detail").when(j("detail") == "false", "collection")
    method = F.explode(F.coalesce(F.from_json(j("methods"), "array<string>"), F.array(j("methods"))))
    found = d.select(F.col("path").alias("def_path"), F.regexp_replace("parent", r"\.[^.]*$", "").alias("def_name"), role.alias("role"), F.coalesce(j("url_path"), _last(F.col("parent"))).alias("action"), method.alias("method"))
    return found.filter("role is not null and method is not null").withColumn("method", F.upper("method"))


def included(facts: DataFrame, modules: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, prefix, route, expression, place) of all urls from ``roots`` (path) on, prefixes gathered through includes.

    One join for each level of includes; a file that includes itself on some way is not
    entered again on that way. ``place`` orders urls as declared.
    """
    urls = written(facts.filter("kind = 'url'").select("path", F.col("name").alias("route"), F.col("target").alias("expression"), "ordinal"))
    level = written(roots.select("path", F.lit("").alias("prefix"), F.array("path").alias("seen"), F.array().cast("array<int>").alias("above")))
    levels = []
    while not level.isEmpty():
        here = level.join(urls, "path").withColumn("place", F.concat("above", F.array("ordinal")))
        levels.append(here.select("path", "prefix", "route", "expression", "place"))
        module = F.regexp_extract("expression", r"""^include\(\(?['"]([\w.]+)['"]""", 1)
        deeper = here.select("seen", F.concat("prefix", "route").alias("prefix"), F.col("place").alias("above"), module.alias("module")).join(modules.select("module", "path"), "module")
        level = written(deeper.filter(~F.array_contains("seen", F.col("path"))).select("path", "prefix", F.concat("seen", F.array("path")).alias("seen"), "above"))
    return reduce(DataFrame.union, levels) if levels else urls.limit(0).select("path", F.lit("").alias("prefix"), "route", "expression", F.array("ordinal").alias("place"))


def endpoints(facts: DataFrame, modules: DataFrame, roots: DataFrame) -> DataFrame:
    """(method, declared_path, normalized_path, def_path, def_name): the first declaration of each method and normalized path that no earlier pattern of the same converters shadows.

    Routers give a collection and a detail url for each registration and one for each action
    of its view set; a collection or detail without methods answers GET.
    """
    # both are asked for many times: sources are parsed once
    facts, modules = written(facts), written(modules)
    found = written(included(facts, modules, roots))
    router = F.regexp_extract("expression", r"^include\((\w+)\.urls\)$", 1)
    views = found.filter(~F.col("expression").startswith("include(")).select("path", F.concat("prefix", "route").alias("declared"), F.regexp_replace("expression", r"\.as_view\(.*\)$", "").alias("expression"), "place", F.lit("view").alias("role"))

    registered = facts.filter("kind = 'register'").select("path", F.col("parent").alias("router"), F.col("name").alias("registered"), F.col("target").alias("expression"), F.col("ordinal").alias("nth"))
    sets = found.withColumn("router", router).drop("expression").join(registered, ["path", "router"])
    collection = F.concat(F.regexp_replace(F.concat("prefix", "route", "registered"), "/+$", ""), F.lit("/"))
    role = lambda name, more, k: F.struct(F.lit(name).alias("role"), F.lit(more).alias("more"), F.lit(k).alias("k"))
    roles = F.array(role("collection", "", 0), role("detail", "<str:pk>/", 1))
    both = sets.select("path", "expression", F.explode(roles).alias("r"), collection.alias("collection"), F.concat("place", F.array("nth")).alias("place"))
    both = both.select("path", F.concat("collection", "r.more").alias("declared"), "expression", F.concat("place", F.array("r.k")).alias("place"), "r.role")

    placed = written(resolved(views.unionByName(both), facts, modules))
    methods = view_methods(facts)
    plain = placed.join(methods, ["def_path", "def_name", "role"], "left").withColumn("method", F.coalesce("method", F.lit("GET")))
    actions = placed.filter("role <> 'view'").join(viewset_actions(facts), ["def_path", "def_name", "role"])
    actions = actions.withColumns({"declared": F.concat("declared", F.regexp_replace("action", "/+$", ""), F.lit("/")), "place": F.concat("place", F.array(F.lit(2)))})
    columns = ["declared", "method", "def_path", "def_name", "place"]
    declared, normalized, _ = django_route(F.lit(""), F.col("declared"))
    rows = plain.select(columns).union(actions.select(columns)).withColumns({"declared_path": declared, "normalized_path": normalized})
    # a pattern behind one that matches the same paths is never reached
    rows = written(rows.withColumn("shadow", F.regexp_replace(F.regexp_replace("declared_path", r"<(\w+)>", "<str>"), r"<(\w+):\w+>", "<$1>")))
    reached = rows.groupBy("shadow").agg(F.min("place").alias("earliest"))
    rows = rows.join(reached, "shadow").filter(F.col("place") == F.col("earliest"))
    first = rows.groupBy("method", "normalized_path").agg(F.min_by(F.struct("declared_path", "def_path", "def_name"), F.struct("place", "declared_path")).alias("d"))
    return first.select("method", "d.declared_path", "normalized_path", "d.def_path", "d.def_name")
