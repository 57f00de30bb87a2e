"""Queries over Django sources that Spark writes from the driver's tables, nested spans, calls, and stored tables that should agree; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import digests, frontend, order, scopes, symbols, validate, variants
from flowloom.queries import query
from flowloom.session import table
from flowloom.sources import django_graph, files


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each part as an app with URLs, views and a model; its size says which lists, helpers and branches they have."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    more = F.when(n % 2 == 0, " + more").otherwise("")
    urls = _text("from django.urls import include, path\nfrom . import views\nmore = [path('m", k, "/<int:pk>/', views.listed)]\nurlpatterns = [path('p", k, "/', views.item)]", more, "\n")
    near = F.when(n % 3 == 0, _text("    def helper():\n        return C", k, ".objects.get()\n")).otherwise("")
    branch = F.when(n % 4 == 0, "    if request:\n        url = 'https://b.test/'\n").otherwise("")
    views = _text(
        "from .models import C", k, "\ndef helper():\n    return {'url': 'https://h", n.cast("string"), ".test:8443/x?token=1', 'method': 'POST'}\ndef item(request):\n", near, "    return helper()\n",
        "def listed(request):\n    C", k, ".objects.filter(pk=1)\n    url = 'https://a.test/'\n", branch, "    return {'url': url}\n",
    )
    models = _text("from django.db import models\nclass C", k, "(models.Model):\n    pass\n")
    sources = F.array(*[F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in (("__init__", F.lit("")), ("urls", urls), ("views", views), ("models", models))])
    return files.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("k"), F.explode(sources).alias("s")).select(_text("a", F.col("k"), "/", F.col("s.name"), ".py").alias("path"), "s.text")


def _fragment(spark: SparkSession, sf_dir: str) -> django_graph.Fragment:
    texts = apps(spark, sf_dir)
    modules = frontend.proved_modules(texts.select("path"), spark.createDataFrame([("",)], "root string"))
    return django_graph.django_fragment(texts, modules, "backend")


_APPS = """WITH p AS (SELECT p_partkey, p_size AS n, 'a' || p_partkey AS app, 'a' || p_partkey || '/views.py' AS v FROM part),
e AS (
SELECT 'url:' || app || '/urls.py:' || CASE WHEN n % 2 = 0 THEN '0.0' ELSE '0' END || ':GET' AS source, 'view:' || v || ':item' AS target, 'resolves_to' AS kind FROM p
UNION ALL SELECT 'url:' || app || '/urls.py:1.0:GET', 'view:' || v || ':listed', 'resolves_to' FROM p WHERE n % 2 = 0
UNION ALL SELECT 'view:' || v || ':item', 'function:' || v || CASE WHEN n % 3 = 0 THEN ':item.helper' ELSE ':helper' END, 'invokes' FROM p
UNION ALL SELECT unnest(['view:' || v || ':item', 'function:' || v || ':item.helper']), unnest(['query:' || v || ':item#1', 'query:' || v || ':item.helper#1']), 'accesses' FROM p WHERE n % 3 = 0
UNION ALL SELECT unnest(['query:' || v || ':item#1', 'query:' || v || ':item.helper#1']), 'model:' || app || '/models.py:C' || p_partkey, 'accesses' FROM p WHERE n % 3 = 0
UNION ALL SELECT 'function:' || v || ':helper', 'external:' || v || ':helper:https:h' || n || '.test:8443', 'calls' FROM p WHERE n % 3 <> 0
UNION ALL SELECT 'view:' || v || ':listed', 'query:' || v || ':listed#1', 'accesses' FROM p WHERE n % 2 = 0
UNION ALL SELECT 'query:' || v || ':listed#1', 'model:' || app || '/models.py:C' || p_partkey, 'accesses' FROM p WHERE n % 2 = 0
UNION ALL SELECT 'view:' || v || ':listed', CASE WHEN n % 4 = 0 THEN 'unresolved:' || v || ':view:' || v || ':listed:dynamic_target_unproven' ELSE 'external:' || v || ':listed:https:a.test:' END, 'calls' FROM p WHERE n % 2 = 0
)"""


@query(f"{_APPS} SELECT source, target, kind FROM e")
def django_call_graph(spark, sf_dir):
    """Edges of an app for each part: URLs by named lists, nearest helpers, queries, and URLs that surely reach a return."""
    return _fragment(spark, sf_dir).edges.select("source", "target", "kind")


@query("""WITH s AS (SELECT o_custkey AS owner, o_orderkey * 1000 AS lo, o_orderkey * 1000 + 900 AS hi FROM orders
UNION ALL SELECT o_custkey, l_orderkey * 1000 + l_linenumber * 100 AS lo, max(l_orderkey * 1000 + l_linenumber * 100 + 1 + l_quantity::BIGINT) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, lo),
q AS (SELECT o_custkey AS owner, l_orderkey * 1000 + (l_partkey * 7 + l_linenumber * 131) % 1000 AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT q.owner, pos, max(lo) AS start, count(lo) AS depth FROM (SELECT DISTINCT * FROM q) q LEFT JOIN s ON s.owner = q.owner AND lo <= pos AND pos < hi GROUP BY q.owner, pos""")
def scope_innermost(spark, sf_dir):
    """Orders as spans with their lines inside, by customer; positions fall into lines, orders or between."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    spans = orders.select("owner", (F.col("o_orderkey") * 1000).alias("start"), (F.col("o_orderkey") * 1000 + 900).alias("end"))
    spans = spans.union(lines.groupBy("owner", at.alias("start")).agg(F.max(at + 1 + F.col("l_quantity").cast("long"))))
    points = lines.select("owner", (F.col("l_orderkey") * 1000 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 131) % 1000).alias("pos")).distinct().withColumn("at", F.col("pos"))
    # one sweep: the spans open at a position are those around it
    return scopes.innermost(points, spans, "owner", count="depth").select("owner", "pos", F.col("span.start").alias("start"), "depth")


@query("""WITH RECURSIVE w(fn, shape) AS (SELECT p_partkey // 2, 'a' || p_size % 3 FROM part WHERE p_size % 5 = 0 AND (p_partkey // 2) % 13 <> 0
UNION SELECT p_partkey // 2, shape FROM w JOIN part ON p_partkey = fn WHERE p_size % 5 <> 0 AND (p_partkey // 2) % 13 <> 0)
SELECT fn, min(shape) AS shape FROM w WHERE fn IN (SELECT p_partkey FROM part) GROUP BY fn HAVING count(DISTINCT shape) = 1""")
def payload_hints(spark, sf_dir):
    """Each part is a function that calls that of half its number, with a literal or with what it was given; some share a name and are never sure."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k, "p_size")
    twice = part.filter(k % 13 == 0).select(k, (k % 13).cast("string").alias("name"))
    functions = part.filter(k % 13 != 0).select(k.alias("fn"), k.cast("string").alias("name")).union(twice)
    parameters = part.select(k.alias("fn"), F.lit(0).alias("index"), F.lit("data").alias("parameter"))
    literal = F.col("p_size") % 5 == 0
    field = F.struct(F.concat(F.lit("a"), (F.col("p_size") % 3).cast("string")).alias("name"), F.lit("text").alias("type"))
    callee = F.floor(k / 2).cast("string")
    arguments = part.select(callee.alias("callee"), k.alias("owner"), F.lit(0).alias("index"), F.when(~literal, "data").alias("root"), F.when(literal, F.array(field)).alias("fields"))
    named = spark.createDataFrame([], "name string, fields array<struct<name:string,type:string>>")
    hints = symbols.payload_hints(functions, parameters, arguments, named)
    return hints.select("fn", F.get("fields", F.lit(0))["name"].alias("shape"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'lost' WHEN o_totalprice > 300000 THEN 'repeated' ELSE 'altered' END AS rule
FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 300000 OR o_orderstatus = 'P'
UNION ALL SELECT -1 - c_custkey, 'added' FROM customer""")
def table_differences(spark, sf_dir):
    """Orders against a copy that lost the cheap ones, repeats the dear ones, alters some in between and has one more for each customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    kept = orders.filter("o_totalprice >= 50000")
    dear = F.col("o_totalprice") > 300000
    altered = kept.withColumn("o_custkey", F.when((F.col("o_orderstatus") == "P") & ~dear, None).otherwise(F.col("o_custkey")))
    more = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit(0.0).cast(orders.schema["o_totalprice"].dataType).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return digests.differences(orders, altered.union(kept.filter(dear)).unionByName(more), ["o_orderkey"])


@query("""WITH r AS (SELECT p_partkey AS pos, p_name AS k1, p_partkey AS k2, lag(p_name) OVER w AS b1, lag(p_partkey) OVER w AS b FROM part WINDOW w AS (ORDER BY p_partkey))
SELECT pos AS position, CASE WHEN k1 < b1 THEN 'unsorted' WHEN k1 = b1 THEN 'doubled' ELSE 'out_of_place' END AS rule FROM r WHERE b IS NOT NULL AND (k1 <= b1 OR pos <> b + 1)""")
def canonical_order(spark, sf_dir):
    """Parts by number, which their names should follow."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey")
    return order.order_faults(rows, "p_partkey", "p_name")


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n FROM part), f AS (
SELECT id, unnest([CASE WHEN n % 7 = 0 THEN '$' END, CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN '$.nodes[0].odd' END, CASE WHEN n % 7 <> 0 AND n % 3 = 0 THEN '$.nodes[1].key' END, CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN '$.name' END]) AS path,
unnest([CASE WHEN n % 7 = 0 THEN 'broken' END, CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN 'unknown_key' END, CASE WHEN n % 7 <> 0 AND n % 3 = 0 THEN 'wrong_type' END, CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 'missing_key' END]) AS rule FROM p)
SELECT * FROM f WHERE rule IS NOT NULL""")
def json_shape_faults(spark, sf_dir):
    """A text for each part with, by its size, a strange key, a number for a text, no name or no end."""
    n, k = F.col("p_size"), F.col("p_partkey").cast("string")
    odd, key = F.when(n % 2 == 0, ',"odd":[{}]').otherwise(""), F.when(n % 3 == 0, k).otherwise(_text('"', k, '"'))
    name, end = F.when(n % 5 == 0, "").otherwise('"name":"x",'), F.when(n % 7 == 0, "").otherwise("}")
    text = _text("{", name, '"nodes":[{"key":"a"', odd, '},{"key":', key, "}]", end)
    shape = {"$": {"name": "string", "nodes": "array"}, "$.nodes[*]": {"key": "string"}}
    return variants.json_faults(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), shape)


_REASON = "CASE event_type WHEN 'click' THEN 'ast_call' WHEN 'view' THEN 'dynamic_target_unproven' ELSE 'guessed' END"


@query(f"""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'unresolved' ELSE 'inferred' END AS kind, {_REASON} AS reason, CASE WHEN value < 50 THEN 'GET /a' ELSE 'GET' END AS label FROM events)
SELECT id, 'evidence_reason' AS rule FROM e WHERE reason = 'guessed' OR (reason = 'ast_call') <> (kind = 'inferred') UNION ALL SELECT id, 'label_form' FROM e WHERE label <> 'GET /a'""")
def node_rules(spark, sf_dir):
    """Each event as an HTTP call whose evidence may have another kind's reason, and whose label may not say its path."""
    kind = F.when(F.col("event_id") % 3 == 0, "unresolved").otherwise("inferred")
    reason = F.when(F.col("event_type") == "click", "ast_call").when(F.col("event_type") == "view", "dynamic_target_unproven").otherwise("guessed")
    none = F.lit(None).cast("string")
    piece = F.struct(kind.alias("kind"), F.lit("a").alias("adapter"), F.lit("1").alias("adapter_version"), none.alias("event_id"), reason.alias("reason"), none.alias("timestamp"))
    label = F.when(F.col("value") < 50, "GET /a").otherwise("GET")
    nodes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("http_call").alias("kind"), F.lit("http").alias("layer"), label.alias("label"), F.lit("GET").alias("method"), F.lit("/a").alias("normalized_path"), F.array(piece).alias("evidence"))
    return validate.node_violations(nodes).select("id", "rule")
