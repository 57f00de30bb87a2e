"""Browser sources: frameworks, nested routes, bounded templates, the choice among repeated declarations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.frontend import joined_route
from flowloom.functions.paths import BUILT_IN_CONVERTERS, CONVERTER_MEMBERS
from flowloom.operators.traverse import bfs
from flowloom.plans.lineage import written
from flowloom.plans.ranking import numbered

#: Members of a template's domains multiplied: more than so many paths count as unbounded.
MOST_PATHS = 4096
#: Rows of members in a part, parts at most that a task writes to as it reads (Spark's threshold for writing without sorting), parts of a domain.
ROWS, STREAMED, BUCKETS = 400_000, 200, 64


def frameworks(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repository, react, vue, nuxt) from files (repository, path) and package manifests (repository, text); a broken manifest counts as empty."""
    depends = lambda name: F.coalesce(*[F.get_json_object("text", f"$.{part}.{name}") for part in ("dependencies", "devDependencies")]).isNotNull()
    named = F.substring_index("path", "/", -1)
    by_file = files.select("repository", named.rlike(r"[^.]\.[jt]sx$").alias("react"), named.rlike(r"[^.]\.vue$").alias("vue"), named.rlike(r"^nuxt\.config\.(?:js|mjs|ts)$").alias("nuxt"))
    by_manifest = manifests.select("repository", depends("react").alias("react"), depends("vue").alias("vue"), depends("nuxt").alias("nuxt"))
    return by_file.union(by_manifest).groupBy("repository").agg(*[F.bool_or(c).alias(c) for c in ("react", "vue", "nuxt")])


def pages_folder(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(repository, folder): the first folder of pages that has a file; ``declared`` (repository, src_dir) names the only candidate where not null."""
    usual = F.array(F.lit("pages"), F.lit("app/pages"), F.lit("src/pages"))
    tried = F.when(F.col("src_dir").isNull(), usual).otherwise(F.array(F.concat("src_dir", F.lit("/pages"))))
    candidates = files.join(declared, "repository", "left").select("repository", "path", F.posexplode(tried).alias("at", "folder"))
    return candidates.filter(F.col("path").startswith(F.concat("folder", F.lit("/")))).groupBy("repository").agg(F.min_by("folder", "at").alias("folder"))


def full_routes(routes: DataFrame) -> DataFrame:
    """(id, path) of nested routes (id, parent, declared, index), level by level; pathless ones hand their parent's path on and have none.

    Every route has a row: those under a missing parent or in a circle have no path, and ``lost_routes`` names them.
    """
    path = joined_route(F.col("above"), F.col("declared"), F.col("index"))
    level = written(routes.filter("parent is null").withColumn("above", F.lit("")).select("id", path.alias("path"), "above"))
    levels = []
    while not level.isEmpty():
        levels.append(level.select("id", "path"))
        parents = level.select(F.col("id").alias("parent"), F.coalesce("path", "above").alias("above"))
        level = written(routes.join(parents, "parent").select("id", path.alias("path"), "above"))
    found = written(reduce(DataFrame.union, levels, level.select("id", "path")))
    return found.union(routes.join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string")))


def lost_routes(routes: DataFrame) -> DataFrame:
    """(id, rule) of nested routes (id, parent) that hang on no root: ``missing_parent`` below a parent that is declared nowhere, else ``circle``."""
    ids = routes.select("id").distinct()
    below = routes.filter("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    orphans = below.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select(F.col("target").alias("node"))
    missed = written(bfs(below, orphans).select(F.col("node").alias("id")))
    placed = bfs(below, routes.filter("parent is null").select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    rest = ids.join(missed, "id", "left_anti").join(placed, "id", "left_anti")
    return missed.select("id", F.lit("missing_parent").alias("rule")).union(rest.select("id", F.lit("circle")))


def dealt_parts(rows: DataFrame) -> int:
    """Partitions that hold about ``ROWS`` each, at least as many as shuffles have, else ``STREAMED`` at most."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(STREAMED, -(-rows.count() // ROWS)))


def bounded_templates(templates: DataFrame, members: DataFrame) -> DataFrame:
    """(id, path, placeholders) of templates (id, path) with members (id, token, value) of their placeholders; unprovable ones are left out.

    A placeholder holds token, member_count, accepted_converters and segment_index. Each
    must be a whole segment and have a converter that accepts all its members, and the
    members multiplied must be at most ``MOST_PATHS``.

    Members are dealt as they are read, over parts that grow in number with them, so that
    neither the reading task nor a part holds more than its share; a domain of many
    members lies in up to ``BUCKETS`` parts and is counted there. The rest is dealt by id.
    """
    parts = dealt_parts(members)
    bit = {c: 1 << i for i, c in enumerate(BUILT_IN_CONVERTERS)}
    fits = reduce(Column.bitwiseOR, [F.when(F.col("value").rlike(CONVERTER_MEMBERS[c]), n).otherwise(0) for c, n in bit.items()])
    dealt = members.select("id", "token", "value", F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int").alias("bucket")).repartition(parts, "id", "token", "bucket")
    counted = dealt.distinct().groupBy("id", "token", "bucket").agg(F.count("*").alias("n"), F.bit_and(F.when(F.col("value").isNotNull(), fits)).alias("fits")).drop("bucket")
    domains = counted.repartition(parts, "id").groupBy("id", "token").agg(F.sum("n").alias("n"), F.bit_and("fits").alias("fits")).filter("token is not null")
    by_id = domains.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("n", "fits")))).alias("domains"))

    segments = F.split(F.substring("path", F.lit(2), F.char_length("path")), "/")
    at = F.transform(segments, lambda s, i: F.struct(i.alias("segment_index"), F.regexp_extract(s, r"^\{(\w+)\}$", 1).alias("token")))
    loose = F.regexp_replace("path", r"/\{\w+\}(?=/|$)", "/").rlike(r"[{}?#\\\s]")
    declared = templates.filter(~loose & F.col("path").startswith("/")).select("id", "path").repartition(parts, "id")
    both = declared.join(by_id, "id").withColumn("tokens", F.filter(at, lambda t: t.token != "")).filter(F.size("tokens") > 0)

    def accepted(domain: Column) -> Column:
        return F.filter(F.array(*[F.when(domain.fits.bitwiseAND(n) != 0, c) for c, n in bit.items()]), lambda c: c.isNotNull())

    def record(t: Column) -> Column:
        domain = F.try_element_at("domains", t.token)
        return F.struct(t.segment_index.alias("segment_index"), t.token.alias("token"), domain.n.alias("member_count"), accepted(domain).alias("accepted_converters"))

    found = both.select("id", "path", F.transform("tokens", record).alias("placeholders"))
    paths = F.aggregate("placeholders", F.lit(1.0), lambda size, p: size * F.coalesce(p.member_count, F.lit(MOST_PATHS + 1)))
    return found.filter(F.forall("placeholders", lambda p: F.size(p.accepted_converters) > 0) & (paths <= MOST_PATHS))


def most_confident(declarations: DataFrame, key: str = "key") -> DataFrame:
    """Of each key the declaration (…, confidence, ordinal) of the highest confidence, of equal ones the first."""
    best = declarations.groupBy(key).agg(F.max(F.struct(F.col("confidence").alias("c"), (-F.col("ordinal")).alias("o"), F.struct("*").alias("row"))).alias("best"))
    return best.select("best.row.*")


def first_of(declarations: DataFrame, *keys: str, ordinal: str = "ordinal") -> DataFrame:
    """The first declaration of each combination of ``keys``; aggregation, so that a key of many rows is combined before the shuffle."""
    return declarations.groupBy(*keys).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.struct("*").alias("row"))).alias("first")).select("first.row.*")


def shadow_key(path: Column) -> Column:
    """A route's path with every parameter alike, so that routes which match the same paths share it."""
    return F.regexp_replace(path, r"\{[^{}/]*\}|<[^<>/]*>", "{}")


def first_endpoints(urls: DataFrame) -> DataFrame:
    """Declared patterns (path, methods, ordinal) to (method, path, ordinal): a pattern behind one of the same shadow key is never reached, a method and path are taken once."""
    seen = first_of(urls.withColumn("shadow", shadow_key(F.col("path"))), "shadow")
    methods = F.when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(F.lit("GET")))
    return first_of(seen.select("path", "ordinal", F.explode(F.array_distinct(methods)).alias("method")), "method", "path").select("method", "path", "ordinal")


def ordinals(items: DataFrame, owner: str, *place: str, start: int = 1) -> DataFrame:
    """``items`` with ``ordinal``, their number among those of the same owner in source order."""
    return items.withColumn("ordinal", F.row_number().over(W.partitionBy(owner).orderBy(*place)) + (start - 1))


def ordered_routes(routes: DataFrame) -> DataFrame:
    """``routes`` (framework, path, repository, node_id, id) with ``rank``: browser routes first, then by path, repository, framework, node and id."""
    return numbered(routes.withColumn("backend", F.col("framework") == "django"), "backend", "path", "repository", "framework", "node_id", "id").drop("backend")


def default_route(routes: DataFrame, chosen: str | None) -> DataFrame:
    """The one route (id, framework, rank) to open: the chosen one if it is still there, else the first browser route, else the first."""
    order = [F.col("id") != F.lit(chosen)] if chosen is not None else []
    return routes.orderBy(*order, F.col("framework") == "django", "rank").limit(1)


def route_search(routes: DataFrame, text: str) -> DataFrame:
    return routes.filter(F.lower("path").contains(text.lower()))


def diagnostics_for(diagnostics: DataFrame, repository: str | None = None, node: str | None = None, edge: str | None = None) -> DataFrame:
    """Those of one selected node or edge, or else those of the whole graph and of the route's repository."""
    if node is not None or edge is not None:
        return diagnostics.filter(F.col("node_id") == node if node is not None else F.col("edge_id") == edge)
    at_large = F.col("node_id").isNull() & F.col("edge_id").isNull()
    return diagnostics.filter(at_large & (F.col("repository").isNull() | F.coalesce(F.col("repository") == F.lit(repository), F.lit(False))))


def proved_modules(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, module) of Python files (path) below roots (root, "" for the top): the dotted name from the deepest root.

    A file whose deepest root gives no name of identifiers falls back to the next one; manage.py has none.
    Every folder above a file is one row, so that roots are found by an equi-join; a project has few
    roots, which go to all tasks, where Spark, that does not know their number, would send the files.
    """
    parts = F.split("path", "/")
    ups = files.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    at = ups.withColumn("root", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).join(F.broadcast(roots.select("root").distinct()), "root")
    rest = F.slice("parts", F.col("depth") + 1, F.size("parts"))
    names = F.transform(rest, lambda p: F.regexp_replace(p, r"\.py$", ""))
    proper = F.forall(names, lambda n: n.rlike(r"^[A-Za-z_]\w*$")) & (F.element_at(rest, -1) != "manage.py")
    kept = F.when((F.element_at(names, -1) == "__init__"), F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)
    found = at.filter(proper).select("path", "depth", F.array_join(kept, ".").alias("module"))
    return found.groupBy("path").agg(F.max_by("module", "depth").alias("module"))


def over_caps(collections: dict[str, DataFrame], caps: dict[str, int]) -> DataFrame:
    """(collection, n, most) of the collections that have more rows than allowed."""
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n", F.lit(caps[name]).cast("long").alias("most")) for name, rows in collections.items()]
    return reduce(DataFrame.union, counted).filter("n > most")
