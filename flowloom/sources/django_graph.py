"""Django projects as graph fragments: URLs to views, helpers, queries, models and external services.

Everything after reading the files' places is joins: names go to their nearest binding by a
sweep over nested scopes, lists of URLs unfold level by level, and what views reach is
followed call by call. What has no single answer stays unresolved and says why.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions import urls as targets
from flowloom.functions.text import authority
from flowloom.operators.scopes import enclosing, innermost, reaching
from flowloom.plans.joins import shuffled
from flowloom.plans.lineage import written
from flowloom.sources.django import view_methods, viewset_actions
from flowloom.sources.files import python_facts
from flowloom.sources.syntax import LAST, python_places

ADAPTER, VERSION = "flowloom.django", "1"
# Converters with rules of their own, and methods of external calls.
CONVERTERS = ("int", "str", "slug", "uuid", "path")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


@dataclass
class Fragment:
    """nodes, edges and routes as ``operators.assemble.canonical`` takes them; diagnostics (code, path)."""

    nodes: DataFrame
    edges: DataFrame
    routes: DataFrame
    diagnostics: DataFrame


def _dots(*parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), ".")


def _detail(name: str) -> Column:
    return F.try_element_at("detail", F.lit(name))


def symbols(places: DataFrame) -> DataFrame:
    """(path, symbol, kind, bases, inside, start, end, line, end_line): the first definition of each name of a file."""
    defs = places.filter("kind in ('function', 'class')")
    first = defs.groupBy("path", "name").agg(F.min_by(F.struct("kind", "value", "inside", "start", "end", "line", "end_line"), "start").alias("d"))
    return first.select("path", F.col("name").alias("symbol"), "d.kind", F.col("d.value").alias("bases"), "d.inside", "d.start", "d.end", "d.line", "d.end_line")


def _scopes(points: DataFrame, defs: DataFrame) -> DataFrame:
    """``points`` with ``span`` replaced by the scope they stand in: start and end of the definition around, or of the module."""
    found = innermost(points, defs.select("path", "start", "end", "symbol"), "path")
    return found.withColumns({"scope_start": F.coalesce("span.start", F.lit(-1)), "scope_end": F.coalesce("span.end", F.lit(LAST))}).drop("span")


def bindings(places: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, name, start, end, symbol, full): what a name means in a scope, a definition of the file or an imported full name; definitions come first."""
    own = modules.groupBy("path").agg(F.count("*").alias("n"), F.first("module").alias("own")).withColumn("own", F.when(F.col("n") == 1, F.split("own", r"\.")))
    level = F.coalesce(_detail("level").cast("int"), F.lit(0))
    i = places.filter("kind = 'import'").select("path", "name", "value", "at", level.alias("level")).join(shuffled(own.select("path", "own")), "path", "left")
    kept = F.coalesce(F.size("own"), F.lit(0)) - F.col("level") + F.col("path").rlike(r"(^|/)__init__\.py$").cast("int")
    package = F.slice(F.coalesce("own", F.array().cast("array<string>")), F.lit(1), F.greatest(kept, F.lit(0)))
    above = (F.col("level") > 0) & ((kept < 0) | F.col("own").isNull() | ((kept == 0) & (F.col("level") > 1)))
    full = F.when(F.col("level") == 0, F.col("value")).when(~above, _dots(F.array_join(package, "."), F.col("value")))
    imports = i.select("path", "name", "at", F.lit(None).cast("string").alias("symbol"), full.alias("full"))
    # a definition stands in the scope around it
    local = defs.select("path", F.substring_index("symbol", ".", -1).alias("name"), (F.col("start") - 1).alias("at"), "symbol", F.lit(None).cast("string").alias("full"))
    scoped = _scopes(imports.union(local), defs)
    best = F.min_by(F.struct("symbol", "full"), F.struct(F.col("symbol").isNull(), F.when(F.col("symbol").isNull(), -F.col("at")).otherwise(F.col("at"))))
    return scoped.groupBy("path", "name", F.col("scope_start").alias("start"), F.col("scope_end").alias("end")).agg(best.alias("b")).select("path", "name", "start", "end", "b.symbol", "b.full")


def resolved(refs: DataFrame, bound: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """``refs`` (path, at, expression, more) with def_path, def_name, def_kind, module (path of the module meant) and outcome.

    The nearest scope that binds the first name decides; of an imported full name the longest
    module that exists is taken, the rest names a definition in it. Outcomes: exact, module (no
    definition, but the module itself), ambiguous (several files of one module), unresolved
    (a module of this project without such a name or file) and outside.
    """
    head = F.substring_index("expression", ".", 1)
    more = F.regexp_extract("expression", r"^[^.]*\.(.*)$", 1)
    numbered = written(refs.withColumn("ref", F.monotonically_increasing_id()))
    near = innermost(numbered.select("ref", "path", "at", head.alias("name"), more.alias("more")), bound, "path", "name").select("ref", "path", "more", "span.symbol", "span.full")
    near = written(near)
    local = near.filter("symbol is not null").select("ref", F.col("path").alias("def_path"), _dots(F.col("symbol"), F.col("more")).alias("def_name"), F.lit("unresolved").alias("missed"))
    known = modules.groupBy("module").agg(F.count("*").alias("files"), F.min("path").alias("module_path"))
    roots = modules.select(F.substring_index("module", ".", 1).alias("root")).distinct()
    parts = F.split("full", r"\.")
    full = near.filter("full is not null").select("ref", _dots(F.col("full"), F.col("more")).alias("full"))
    split = full.select("ref", "full", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    split = split.select("ref", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), ".").alias("module"), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), ".").alias("rest"))
    longest = split.join(shuffled(known), "module").groupBy("ref").agg(F.max_by(F.struct("files", "module_path", "rest"), "k").alias("m"))
    there = full.join(shuffled(longest), "ref", "left").withColumn("root", F.substring_index("full", ".", 1)).join(shuffled(roots.withColumn("ours", F.lit(True))), "root", "left")
    outcome = F.when(F.col("m.files") > 1, "ambiguous").when(F.col("m").isNull() & F.col("ours").isNull(), "outside").when(F.col("m").isNotNull() & (F.col("m.rest") == ""), "module").otherwise("unresolved")
    imported = there.select("ref", F.when(F.col("m.files") == 1, F.col("m.module_path")).alias("def_path"), F.col("m.rest").alias("def_name"), outcome.alias("missed"))
    tried = local.union(imported).join(shuffled(defs.select(F.col("path").alias("def_path"), F.col("symbol").alias("def_name"), F.col("kind").alias("def_kind"))), ["def_path", "def_name"], "left")
    got = tried.select("ref", F.col("def_path").alias("module"), F.when(F.col("def_kind").isNotNull(), F.col("def_path")).alias("def_path"), F.col("def_name").alias("rest"), F.when(F.col("def_kind").isNotNull(), F.col("def_name")).alias("def_name"), "def_kind", F.when(F.col("def_kind").isNotNull(), "exact").otherwise(F.col("missed")).alias("outcome"))
    return numbered.join(shuffled(got), "ref", "left").withColumn("outcome", F.coalesce("outcome", F.lit("outside"))).drop("ref")


def url_roots(places: DataFrame, modules: DataFrame, included: DataFrame) -> DataFrame:
    """(path) of the files that URLs start from.

    Where a settings file sets ROOT_URLCONF, its one literal value must name one file, or there is no root; else the files
    called urls.py that no other includes (``included``: path), or all of these if each is included.
    """
    settings = places.filter("kind = 'assign' and name = 'ROOT_URLCONF' and inside = '' and start = -1").filter(F.col("path").endswith("settings.py") | F.concat(F.lit("/"), "path").contains("/settings/"))
    stated = settings.agg(F.count("*").alias("n"), F.count("value").alias("literal"), F.countDistinct("value").alias("values"), F.min("value").alias("module"))
    named = stated.filter("n = literal and values = 1").join(modules, "module").groupBy("module").agg(F.count("*").alias("files"), F.min("path").alias("path")).filter("files = 1").select("path")
    files = places.select("path").distinct().filter(F.col("path").endswith("urls.py"))
    free = files.join(shuffled(included.select("path").distinct()), "path", "left_anti")
    marked = written(named.select("path", F.lit(0).alias("order")).union(stated.filter("n > 0").select(F.lit(None).cast("string"), F.lit(0))).union(free.select("path", F.lit(1))).union(files.select("path", F.lit(2))))
    first = marked.agg(F.min("order").alias("order"))
    return marked.join(first, "order").filter("path is not null").select("path")


def url_entries(places: DataFrame, bound: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, prefix, route, view, router, index, place, at, line, end_line): all URLs from the roots on, lists unfolded.

    A list is a name of a file. Its entries are routes, which may include another list by
    module, by name or by an imported name, and further lists that it is added to. Each round unfolds
    one level by a join; places concatenate, so their order is the order of
    declaration, and a list that stands in itself is not entered again on that way, but a list
    that stands in two places is there twice.
    """
    entries = places.filter("kind in ('url', 'extend')").select(
        "path", F.col("name").alias("list"), "kind", F.col("value").alias("route"), "place", "at", "line", "end_line", F.split(_detail("index"), r"\.").cast("array<int>").alias("index"),
        _detail("view").alias("view"), _detail("router").alias("router"), _detail("module").alias("module"), _detail("unknown").alias("unknown"), F.when(F.col("kind") == "extend", F.col("value")).otherwise(F.when(_detail("router").isNull(), _detail("include"))).alias("expression"),
    )
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()))
    lists = places.filter("kind in ('assign', 'url', 'extend') and inside = ''").select("path", F.col("name").alias("list")).distinct()
    by_text = entries.filter("module is not null").select("entry", "module")
    known = modules.groupBy("module").agg(F.count("*").alias("files"), F.min("path").alias("to_path")).filter("files = 1")
    by_text = by_text.join(shuffled(known), "module").select("entry", "to_path", F.lit("urlpatterns").alias("to_list"))
    named = entries.filter("expression is not null").select("entry", "path", "at", "expression")
    own = named.join(shuffled(lists.withColumnRenamed("list", "expression")), ["path", "expression"]).select("entry", F.col("path").alias("to_path"), F.col("expression").alias("to_list"))
    elsewhere = resolved(named.join(shuffled(own.select("entry")), "entry", "left_anti"), bound, defs, modules).filter("module is not null and outcome in ('module', 'unresolved')")
    elsewhere = elsewhere.select("entry", F.col("module").alias("to_path"), F.when(F.col("outcome") == "module", "urlpatterns").otherwise(F.col("rest")).alias("to_list"))
    leads = written(by_text.union(own).union(elsewhere.join(shuffled(lists.toDF("to_path", "to_list")), ["to_path", "to_list"], "left_semi").select("entry", "to_path", "to_list")))
    entries = written(entries.join(shuffled(leads), "entry", "left").drop("entry"))
    roots = url_roots(places, modules, entries.filter("kind = 'url' and to_path <> path").select(F.col("to_path").alias("path")))

    key = F.struct("path", "list")
    start = roots.select("path", F.lit("urlpatterns").alias("list"), F.lit("").alias("prefix"), F.array().cast("array<int>").alias("before"), F.array().cast("array<int>").alias("above"), F.col("path").alias("root"))
    level = written(start.withColumn("seen", F.array(key)))
    levels = []
    while not level.isEmpty():
        here = level.join(shuffled(entries), ["path", "list"]).withColumns({"place": F.concat("above", "place"), "index": F.concat("before", "index")})
        goes = F.col("to_path").isNotNull() & F.col("route").isNotNull()
        levels.append(here.filter(~goes & (F.col("kind") == "url")).select("root", "path", "prefix", "route", "view", "router", "unknown", "index", "place", "at", "line", "end_line"))
        # the index of a list called urlpatterns starts anew, that of another goes on
        before = F.when((F.col("to_list") == "urlpatterns") & (F.col("kind") == "url"), F.col("before")).otherwise(F.col("index"))
        prefix = F.when(F.col("kind") == "extend", F.col("prefix")).otherwise(joined(F.col("prefix"), F.col("route")))
        deeper = here.filter(goes).select(F.col("to_path").alias("path"), F.col("to_list").alias("list"), prefix.alias("prefix"), before.alias("before"), F.col("place").alias("above"), "root", "seen")
        level = written(deeper.filter(~F.array_contains("seen", key)).withColumn("seen", F.concat("seen", F.array(key))))
    none = entries.limit(0).withColumns({"root": F.lit(""), "prefix": F.lit("")}).select("root", "path", "prefix", "route", "view", "router", "unknown", "index", "place", "at", "line", "end_line")
    return reduce(DataFrame.union, levels, none)


def joined(prefix: Column, route: Column) -> Column:
    return F.when(prefix == "", route).otherwise(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), F.ltrim(route, F.lit("/"))))


def routed(prefix: Column, route: Column) -> Column:
    """(declared, normalized, shadow, converters) of a prefix and a route, or null: no patterns, dot or empty segments, malformed converters."""
    whole = joined(prefix, route)
    legal = lambda t: ~t.rlike(r"[\s\x00-\x1f\x7f^$()\[\]\\%?#]") & ~F.exists(F.split(t, "/"), lambda s: s.isin(".", ".."))
    segments = F.filter(F.split(whole, "/"), lambda s: s != "")
    converter = r"^<(?:([A-Za-z_]\w*):)?([A-Za-z_]\w*)>$"
    proper = F.forall(segments, lambda s: s.rlike(converter) | ~s.rlike("[<>]"))
    kind = lambda s: F.when(F.regexp_extract(s, converter, 1) == "", "str").otherwise(F.regexp_extract(s, converter, 1))
    nth = lambda i: F.size(F.filter(F.slice(segments, F.lit(1), i), lambda s: s.startswith("<")))
    normal = F.transform(segments, lambda s, i: F.when(s.startswith("<"), F.concat(F.lit("{p"), nth(i).cast("string"), F.lit("}"))).otherwise(s))
    shadow = F.transform(segments, lambda s: F.when(s.startswith("<"), F.concat(F.lit("<"), kind(s), F.lit(">"))).otherwise(s))
    places = F.transform(segments, lambda s, i: F.struct(F.regexp_extract(s, converter, 2).alias("name"), F.when(kind(s).isin(*CONVERTERS), kind(s)).otherwise("custom").alias("kind"), i.cast("int").alias("segment_index"), s.startswith("<").alias("is")))
    found = F.transform(F.filter(places, lambda p: p["is"]), lambda p: F.struct(p["name"].alias("name"), p["kind"].alias("kind"), p["segment_index"].alias("segment_index")))
    last = F.when(whole.endswith("/") & (F.size(segments) > 0), "/").otherwise("")
    path = lambda parts: F.concat(F.lit("/"), F.array_join(parts, "/"), last)
    ok = route.isNotNull() & legal(route) & legal(whole) & ~whole.startswith("/") & ~whole.contains("//") & proper
    return F.when(ok, F.struct(path(segments).alias("declared"), path(normal).alias("normalized"), path(shadow).alias("shadow"), found.alias("converters")))


def url_patterns(entries: DataFrame, facts: DataFrame, bound: DataFrame, defs: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The URL patterns with their method and view, and the entries that are none (code, path).

    Columns: path, at, line, end_line, index, method, declared, normalized, converters, def_path, def_name, def_kind, outcome.
    A registration of a router gives a collection, a detail and its view set's actions. Of patterns that
    match the same paths the first declared stays, and of one method and normalized path the first.
    """
    plain = entries.filter("router is null").withColumns({"declared": F.lit(""), "role": F.lit("view")})
    unfit = plain.filter("view is null")
    nth = F.row_number().over(W.partitionBy("path", "router").orderBy("ordinal")) - 1
    registered = facts.filter("kind = 'register'").select("path", F.col("parent").alias("router"), F.col("name").alias("registered"), F.col("target").alias("set"), "ordinal").withColumn("nth", nth)
    sets = entries.filter("router is not null").join(shuffled(registered), ["path", "router"])
    base = joined(joined(F.col("prefix"), F.coalesce("route", F.lit(""))), F.col("registered"))
    base = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    role = lambda name, more, *k: F.struct(F.lit(name).alias("role"), F.lit(more).alias("more"), F.array(*map(F.lit, k)).cast("array<int>").alias("k"))
    sets = sets.withColumns({"base": base, "r": F.explode(F.array(role("collection", ""), role("detail", "<str:pk>/", 1)))})
    sets = sets.withColumns({
        "prefix": F.lit(""), "route": F.concat("base", "r.more"), "view": F.regexp_replace("set", r"\.as_view\(.*\)$", ""), "role": F.col("r.role"),
        "index": F.concat("index", F.array("nth"), "r.k"), "place": F.concat("place", F.array("nth"), F.when(F.col("r.role") == "detail", F.array(F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    columns = ["root", "path", "prefix", "route", "view", "role", "index", "place", "at", "line", "end_line"]
    asked = plain.filter("view is not null").select(columns).union(sets.select(columns)).withColumnRenamed("view", "expression")
    placed = written(resolved(asked, bound, defs, modules))
    methods = view_methods(facts)
    found = placed.join(shuffled(methods), ["def_path", "def_name", "role"], "left").withColumn("method", F.coalesce("method", F.lit("GET")))
    actions = placed.filter("role <> 'view'").join(shuffled(viewset_actions(facts)), ["def_path", "def_name", "role"])
    after = F.array(F.lit(2), F.when(F.col("role") == "detail", 1).otherwise(0))
    stem = F.when(F.col("role") == "detail", F.slice("index", F.lit(1), F.size("index") - 1)).otherwise(F.col("index"))
    actions = actions.withColumns({"route": F.concat("route", F.rtrim("action", F.lit("/")), F.lit("/")), "index": F.concat(stem, F.array(F.lit(2))), "place": F.concat(F.slice("place", F.lit(1), F.size("place") - 1), after)})
    all_ = found.select(*[c for c in found.columns if c in actions.columns]).unionByName(actions.select(*[c for c in actions.columns if c in found.columns]))
    all_ = written(all_.withColumn("url", routed(F.col("prefix"), F.col("route"))).withColumn("order", F.struct("root", "place")))
    bad = all_.filter("url is null").select("path").union(unfit.select("path")).distinct().select(F.lit("unresolved_django_url").alias("code"), "path")
    good = all_.filter("url is not null").select("*", "url.declared", "url.normalized", "url.shadow", "url.converters")
    earliest = good.groupBy("shadow").agg(F.min("order").alias("first"))
    good = good.join(shuffled(earliest), "shadow").filter(F.col("order") == F.col("first"))
    keep = ["path", "at", "line", "end_line", "index", "declared", "converters", "def_path", "def_name", "def_kind", "outcome"]
    first = good.groupBy("method", "normalized").agg(F.min_by(F.struct(*keep), F.struct("order", "declared")).alias("u"))
    return first.select("method", "normalized", "u.*"), bad


def reached_owners(views: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, symbol) of ``views`` and of all that they call, call by call; ``calls``: path, symbol, def_path, def_name."""
    seen = written(views.select("path", "symbol").distinct())
    level, levels = seen, [seen]
    while not level.isEmpty():
        called = level.join(shuffled(calls), ["path", "symbol"]).select(F.col("def_path").alias("path"), F.col("def_name").alias("symbol")).distinct()
        level = written(called.join(shuffled(reduce(DataFrame.union, levels)), ["path", "symbol"], "left_anti"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


def boundaries(places: DataFrame, defs: DataFrame) -> DataFrame:
    """(path, symbol, url, method): the first dict with a url that each definition returns; null url where it is not surely known.

    A name is what the last assignment before gave it in its own scope, or, if that scope does not
    set it, at the module's end; an assignment in a branch or loop settles it inside of that only.
    """
    asked = places.filter("kind = 'boundary'").select("path", "at", "name", "value", "rank", _detail("known").alias("known"), _detail("method").alias("method"))
    sets = places.filter("kind = 'assign'").select("path", "name", "at", "start", "end", "value", "inside", _detail("after").cast("long").alias("after"), _detail("outer").alias("outer"))
    module_wide = F.col("outer").isNotNull()
    sets = written(_scopes(sets, defs).withColumn("scope", F.when(module_wide, -1).otherwise(F.col("scope_start"))))
    uses = written(_scopes(asked.withColumn("use", F.monotonically_increasing_id()), defs).withColumnRenamed("scope_start", "scope").drop("scope_end"))
    named = uses.filter("name is not null").select("use", "path", "name", "at", "scope")
    local = named.join(shuffled(sets.select("path", "name", "scope").distinct()), ["path", "name", "scope"], "left_semi")
    late = named.join(shuffled(local.select("use")), "use", "left_anti").withColumns({"at": F.when(F.col("scope") == -1, F.col("at")).otherwise(F.lit(LAST - 1)), "scope": F.lit(-1).cast("long")})
    told = sets.select("path", "name", "scope", F.col("after").alias("at"), "start", "end", "value")
    known = reaching(local.union(late.select(local.columns)), told, "path", "name", "scope").select("use", F.col("value").alias("meant"))
    found = uses.join(shuffled(known), "use", "left").withColumn("url", F.coalesce("value", "meant"))
    around = enclosing(found.select("path", "at", "rank", "url", "method"), defs.select("path", "start", "end", "symbol"), "path")
    return around.groupBy("path", F.col("span.symbol").alias("symbol")).agg(F.min_by(F.struct("url", "method"), "rank").alias("b")).select("path", "symbol", "b.url", "b.method")


def django_fragment(files: DataFrame, modules: DataFrame, repository: str) -> Fragment:
    """The fragment of one project from its ``files`` (path, text) and the ``modules`` (path, module) that they are.

    Calls in a definition count for it and for all definitions around it. Views and what they
    call are nodes, with their queries, models and at most one external service each.
    """
    places = written(python_places(files))
    facts = written(python_facts(files))
    modules = written(modules.filter("module is not null and module <> ''"))
    defs = written(symbols(places))
    bound = written(bindings(places, defs, modules))
    entries = written(url_entries(places, bound, defs, modules))
    patterns, unfit = url_patterns(entries, facts, bound, defs, modules)
    patterns = written(patterns.withColumn("key", F.concat_ws(":", F.lit("url"), "path", F.array_join(F.col("index").cast("array<string>"), "."), "method")))
    views = written(patterns.filter("def_kind is not null").select(F.col("def_path").alias("path"), F.col("def_name").alias("symbol")).distinct())

    raw = places.filter("kind = 'call'").select("path", "at", "line", "end_line", "rank", F.coalesce("value", "name").alias("expression"), F.col("value").alias("model"), _detail("operation").alias("operation"))
    called = written(resolved(raw.filter("expression is not null"), bound, defs, modules))
    bases = defs.select(F.col("path").alias("def_path"), F.col("symbol").alias("def_name"), F.exists(F.split("bases", ","), lambda b: (b == "Model") | b.endswith(".Model")).alias("is_model"))
    called = written(called.join(shuffled(bases), ["def_path", "def_name"], "left").withColumn("query", F.coalesce(F.col("model").isNotNull() & F.col("is_model"), F.lit(False))))
    owned = written(enclosing(called, defs.select("path", "start", "end", "symbol"), "path").withColumn("symbol", F.col("span.symbol")).drop("span", "out"))
    helpers = owned.filter("not query and model is null and def_kind = 'function'").select("path", "symbol", "def_path", "def_name").distinct()
    owners = written(reached_owners(views, helpers))

    in_view = owners.join(shuffled(views.withColumn("is_view", F.lit(True))), ["path", "symbol"], "left").join(shuffled(defs.select("path", "symbol", "line", "end_line")), ["path", "symbol"])
    stem = F.when(F.col("is_view"), "view").otherwise("function")
    owner_keys = written(in_view.withColumn("key", F.concat_ws(":", stem, "path", "symbol")))
    keys = shuffled(owner_keys.select("path", "symbol", F.col("key").alias("owner")))
    invoked = helpers.join(keys, ["path", "symbol"]).select("owner", F.concat_ws(":", F.lit("function"), "def_path", "def_name").alias("target"), "def_path", "def_name")
    invoked = written(invoked.filter("owner <> target").distinct())
    # a view that is also called is a function as well
    functions = invoked.select(F.col("def_path").alias("path"), F.col("def_name").alias("symbol")).distinct().join(shuffled(defs), ["path", "symbol"])

    nth = F.row_number().over(W.partitionBy("path", "symbol").orderBy("at", "rank"))
    queries = owned.filter("query").join(keys, ["path", "symbol"]).withColumn("nth", nth)
    queries = written(queries.withColumn("key", F.concat(F.lit("query:"), "path", F.lit(":"), "symbol", F.lit("#"), F.col("nth").cast("string"))))
    outside = boundaries(places, defs).join(keys, ["path", "symbol"])
    to = targets.external_target(F.col("url"))
    outside = written(outside.withColumn("to", F.when(F.col("method").isin(*METHODS), to)).withColumn("key", F.concat_ws(":", F.lit("external"), "path", "symbol", "to.scheme", "to.host", F.coalesce(F.col("to.port").cast("string"), F.lit("")))))

    text = lambda value: F.lit(value).cast("string")
    none = text(None)
    own = shuffled(modules.groupBy("path").agg(F.count("*").alias("n"), F.min("module").alias("module")).filter("n = 1").select("path", "module"))
    qualified = F.when(F.col("module").isNotNull(), _dots(F.col("module"), F.col("symbol")))

    def node(rows: DataFrame, kind: str, key: Column, identity: Column, label: Column, confidence: float, reason: str, kinds: str = "inferred", **more: Column) -> DataFrame:
        given = {
            "key": key, "kind": F.lit(kind), "path": F.col("path"), "identity": identity, "label": label, "confidence": F.lit(confidence), "reason": F.lit(reason), "evidence_kind": F.lit(kinds),
            "symbol": none, "line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"), "qualified_name": none, "method": none, "normalized_path": none, "declared_path": none, "endpoint_id": none,
            "converters": F.lit(None).cast("array<struct<name:string,kind:string,segment_index:int>>"), "reason_code": none, "operation": none, "model_name": none, "boundary": none,
        } | more
        return rows.select(*[c.alias(name) for name, c in given.items()])

    lexical = lambda kind: F.concat(F.lit(f"{kind}:"), "path", F.lit(":lexical:"), "symbol")
    short = F.substring_index("symbol", ".", -1)
    at = {"line": F.col("line"), "end_line": F.col("end_line")}
    named = {"symbol": F.col("symbol"), "qualified_name": qualified} | at
    is_model = F.exists(F.split("bases", ","), lambda b: (b == "Model") | b.endswith(".Model"))
    models = defs.filter("kind = 'class'").filter(is_model).join(own, "path", "left")
    endpoint = F.concat("method", F.lit(" "), "normalized")
    identity = F.concat(F.lit("url:"), "path", F.lit(":urlpatterns:"), F.array_join(F.col("index").cast("array<string>"), "."), F.lit(":"), "method")
    modelled = queries.drop("module").join(own.select(F.col("path").alias("def_path"), "module"), "def_path", "left")
    shown = F.to_json(F.struct("method", "to.scheme", "to.host", "to.port", "to.path_present", "to.query_field_count", "to.has_sensitive_query"))
    lost = patterns.filter("def_kind is null").select("path", F.col("key").alias("owner"), F.lit("dynamic_target_unproven").alias("reason"))
    lost = lost.union(outside.filter("to is null").select("path", "owner", F.lit("dynamic_target_unproven"))).distinct()
    missing = F.concat_ws(":", F.lit("unresolved"), "path", "owner", "reason")
    external = F.concat("method", F.lit(" "), "to.scheme", F.lit("://"), authority(F.col("to.host"), F.col("to.port")))
    nodes = [
        node(patterns, "django_url_pattern", F.col("key"), identity, F.lit("URL pattern"), 0.9, "django_url_declaration", method=F.col("method"), normalized_path=F.col("normalized"), declared_path=F.col("declared"), endpoint_id=endpoint, converters=F.col("converters"), **at),
        node(owner_keys.filter("is_view").join(own, "path", "left"), "django_view", F.col("key"), lexical("view"), short, 0.9, "django_view_binding", **named),
        node(functions.join(own, "path", "left"), "function", F.concat_ws(":", F.lit("function"), "path", "symbol"), lexical("function"), short, 0.85, "ast_symbol_declaration", **named),
        node(models, "model", F.concat_ws(":", F.lit("model"), "path", "symbol"), lexical("model"), short, 0.9, "ast_symbol_declaration", **named),
        node(modelled, "query_boundary", F.col("key"), F.concat(F.lit("query:"), "path", F.lit(":owner:"), "symbol", F.lit(":query:"), F.col("nth").cast("string")), F.col("operation"), 0.8, "django_query_call", operation=F.col("operation"), model_name=F.when(F.col("module").isNotNull(), _dots(F.col("module"), F.col("def_name"))), symbol=F.col("symbol"), **at),
        node(outside.filter("to is not null"), "external_service", F.col("key"), F.col("key"), external, 0.8, "external_boundary", method=F.col("method"), boundary=shown, symbol=F.col("symbol")),
        node(lost, "unresolved_target", missing, missing, F.lit("Unresolved"), 0.3, "dynamic_target_unproven", "unresolved", reason_code=F.col("reason")),
    ]

    def edge(rows: DataFrame, source: Column, target: Column, kind: str, confidence: float, reason: str, kinds: str = "inferred", tier: str | None = None) -> DataFrame:
        return rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.lit(kinds).alias("evidence_kind"), text(tier).alias("tier"))

    view_key = F.concat_ws(":", F.lit("view"), "def_path", "def_name")
    unresolved = lambda rows: rows.withColumn("reason", F.lit("dynamic_target_unproven"))
    edges = [
        edge(patterns.filter("def_kind is not null"), F.col("key"), view_key, "resolves_to", 0.9, "django_view_binding", tier="declared_path"),
        edge(unresolved(patterns.filter("def_kind is null").withColumnRenamed("key", "owner")), F.col("owner"), missing, "resolves_to", 0.3, "dynamic_target_unproven", "unresolved", "unbounded"),
        edge(invoked, F.col("owner"), F.col("target"), "invokes", 0.8, "ast_call"),
        edge(queries, F.col("owner"), F.col("key"), "accesses", 0.8, "django_query_call"),
        edge(queries, F.col("key"), F.concat_ws(":", F.lit("model"), "def_path", "def_name"), "accesses", 0.8, "django_query_call"),
        edge(outside.filter("to is not null"), F.col("owner"), F.col("key"), "calls", 0.8, "external_boundary"),
        edge(unresolved(outside.filter("to is null")), F.col("owner"), missing, "calls", 0.3, "dynamic_target_unproven", "unresolved"),
    ]
    tagged = {"adapter": F.lit(ADAPTER), "adapter_version": F.lit(VERSION), "repository": F.lit(repository)}
    routes = patterns.groupBy("normalized").agg(F.min_by("key", "index").alias("key"), F.min_by("path", "index").alias("path"))
    routes = routes.select("key", F.lit("django").alias("framework"), F.col("normalized").alias("path"))
    codes = F.when(F.col("outcome") == "ambiguous", "python_import_module_ambiguous").when(F.col("outcome") == "unresolved", "python_import_module_unresolved")
    refused = patterns.select("path", codes.alias("code")).union(owned.join(keys, ["path", "symbol"], "left_semi").filter("module is null").select("path", codes.alias("code"))).filter("code is not null")
    broken = places.filter("kind = 'unsupported_syntax'").select(F.lit("unsupported_syntax").alias("code"), "path")
    diagnostics = broken.union(unfit).union(refused.select("code", "path")).distinct()
    return Fragment(reduce(DataFrame.union, nodes).distinct().withColumns(tagged), reduce(DataFrame.union, edges).distinct().withColumns(tagged), routes.withColumns(tagged), diagnostics)
