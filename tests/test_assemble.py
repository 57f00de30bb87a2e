"""Fragments assembled, stored and read back."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowloom import engine
from flowloom.model import Graph
from flowloom.operators import assemble

CALLS = "adapter string, adapter_version string, repository string, key string, kind string, path string, method string, url_resolution string, normalized_path string, endpoint_id string, target_repository string, converters array<struct<name:string,kind:string,segment_index:int>>, confidence double"
EDGES = "adapter string, adapter_version string, repository string, source string, target string, kind string, tier string"
PROOFS = "call_id string, normalized_path string, placeholders array<struct<segment_index:int,accepted_converters:array<string>>>"


def sha(prefix, *parts):
    return prefix + hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()


def web(*rows):
    return [("js", "1", "web", key, kind, "src/a.ts", *rest) for key, kind, *rest in rows]


def shop(*rows):
    return [("py", "1", "shop", key, "django_url_pattern", "urls.py", None, None, path, endpoint, None, converters, 0.9) for key, path, endpoint, converters in rows]


@pytest.fixture
def fragments(spark):
    calls = web(
        ("hit", "http_call", "GET", "literal", "/items", "GET /items", None, None, 0.86),
        ("miss", "http_call", "GET", "literal", "/none", "GET /none", None, None, 0.86),
        ("twice", "http_call", "GET", "literal", "/two", "GET /two", None, None, 0.86),
        ("odd", "http_call", "GET", "literal", "/items", "GET /other", None, None, 0.86),
        ("post", "http_call", "POST", "literal", "/items", "POST /items", None, None, 0.86),
        ("body", "request_payload", None, None, None, None, None, None, 0.7),
        ("one", "http_call", "GET", "bounded_template", "/items/{p0}", None, None, None, 0.8),
        ("free", "http_call", "GET", "unbounded", "/{u0}", None, None, None, 0.8),
        ("old", "unresolved_target", None, None, None, None, None, None, 0.3),
        ("held", "unresolved_target", None, None, None, None, None, None, 0.3),
    )
    edges = [("js", "1", "web", *e) for e in [("post", "body", "carries", None), ("hit", "old", "resolves_to", "unbounded"), ("miss", "held", "resolves_to", "unbounded"), ("free", "held", "resolves_to", "unbounded")]]
    patterns = shop(
        ("a", "/items", "GET /items", None), ("b", "/two", "GET /two", None), ("c", "/two", "GET /two", None), ("d", "/items", "POST /items", None),
        ("e", "/items/{p0}", "GET /items/{p0}", [("pk", "int", 1)]), ("f", "/items/{p0}", "GET /items/{p0}", [("rest", "path", 1)]), ("g", "/none", "GET /elsewhere", None),
    )
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return [(frame(calls, CALLS), frame(edges, EDGES), None), (frame(patterns, CALLS), frame([], EDGES), None)]


@pytest.fixture
def proofs(spark):
    return spark.createDataFrame([(sha("n_", "node", "web", "src/a.ts", "http_call", "one"), "/items/{p0}", [(1, ["int", "slug"])])], PROOFS)


@pytest.fixture
def namespaces(spark):
    return spark.createDataFrame([("web",), ("shop",)], "namespace string")


def test_calls_get_their_only_target_or_an_unresolved_node(spark, fragments, proofs, namespaces):
    graph, conflicts = assemble.merged([assemble.canonical(*f) for f in fragments], proofs, namespaces)
    assert conflicts.count() == 0
    nodes = {r.id: r for r in graph.nodes.collect()}
    edges = graph.edges.collect()
    key = lambda n: nodes[n].identity_key
    bound = {(key(e.source), key(e.target), e.tier, e.confidence, e.target_repository) for e in edges if e.kind == "resolves_to" and nodes[e.target].kind == "django_url_pattern"}
    assert bound == {("hit", "a", "exact_endpoint", 0.86, "shop"), ("body", "d", "exact_endpoint", 0.7, "shop"), ("one", "e", "dynamic_converter", 0.8, "shop")}
    missed = {key(e.source): nodes[e.target] for e in edges if nodes[e.target].kind == "unresolved_target"}
    assert {k: n.reason_code for k, n in missed.items()} == {"miss": "url_target_unmatched", "odd": "url_target_unmatched", "twice": "url_target_ambiguous", "free": None}
    call = sha("n_", "node", "web", "src/a.ts", "http_call", "miss")
    identity = "unresolved:" + ":".join(call[2:][i : i + 4] for i in range(0, 64, 4)) + ":url_target_unmatched"
    assert missed["miss"].id == sha("n_", "node", "web", "src/a.ts", "unresolved_target", identity)
    assert missed["twice"].candidate_ids == sorted(i for i, n in nodes.items() if n.identity_key in "bc")
    names = {n.identity_key for n in nodes.values()}
    assert "old" not in names and "held" in names
    by_key = {n.identity_key: n for n in nodes.values()}
    assert (by_key["one"].endpoint_id, by_key["one"].target_repository) == ("GET shop:/items/{p0}", "shop")
    assert by_key["miss"].endpoint_id is None and by_key["hit"].endpoint_id == "GET /items"
    assert len({e.id for e in edges}) == len(edges) and len(nodes) == graph.nodes.count()


def test_diagnostic_ids(spark, fragments, proofs, namespaces):
    graph, _ = assemble.merged([assemble.canonical(*f) for f in fragments], proofs, namespaces)
    found = graph.diagnostics.collect()
    assert len(found) == 3
    for d in found:
        fields = [d.code, d.severity, d.message, d.repository, None, d.node_id, None, d.candidate_ids, None]
        assert d.id == sha("d_", *[json.dumps(x, separators=(",", ":")) for x in fields])


def test_merging_again_changes_nothing(spark, fragments, proofs, namespaces):
    first, _ = assemble.merged([assemble.canonical(*f) for f in fragments], proofs, namespaces)
    again, conflicts = assemble.merged([first, first], proofs, namespaces)
    assert conflicts.count() == 0
    hits = lambda g: {(r.source, r.target) for r in g.edges.filter("tier in ('exact_endpoint', 'dynamic_converter')").collect()}
    assert hits(again) == hits(first)


def test_conflicts_and_repeated_keys(spark, fragments, proofs, namespaces):
    a = assemble.canonical(*fragments[0])
    b = Graph(a.nodes.withColumn("label", F.lit("other")), a.edges)
    _, conflicts = assemble.merged([a, b], proofs, namespaces)
    assert {r.rule for r in conflicts.collect()} == {"nodes_conflict"} and conflicts.count() == a.nodes.count()
    assert assemble.repeated_keys(fragments[0][0].union(fragments[0][0])).count() == 10


def test_empty_fragments(spark, namespaces):
    empty = (spark.createDataFrame([], CALLS), spark.createDataFrame([], EDGES), None)
    graph, conflicts = assemble.merged([assemble.canonical(*empty)], spark.createDataFrame([], PROOFS), namespaces)
    assert (graph.nodes.count(), graph.edges.count(), graph.diagnostics.count(), conflicts.count()) == (0, 0, 0, 0)


def test_store(spark, tmp_path, fragments, proofs, namespaces):
    store = engine.Store(spark, str(tmp_path / "s"), "p", "set1")
    with pytest.raises(engine.GraphNotFound):
        store.load()
    graph = engine.analyze(store, fragments, proofs, namespaces)
    assert graph.nodes.count() == store.load().nodes.count() > 0 and graph.routes.count() == 0
    with pytest.raises(engine.RepositorySetMismatch):
        engine.Store(spark, store.root, "p", "set2").load()
    store.save(Graph(graph.nodes.limit(1), graph.edges.limit(0)))
    assert (store.load().nodes.count(), store.load().edges.count(), store.load().diagnostics.count()) == (1, 0, 0)
    seen = F.transform("evidence", lambda e: e.withField("kind", F.lit("observed")))
    with pytest.raises(engine.GraphContractError):
        store.save(Graph(graph.nodes.withColumn("evidence", seen), graph.edges))
    with pytest.raises(engine.GraphContractError):
        engine.analyze(store, [(fragments[0][0].union(fragments[0][0]), *fragments[0][1:])], proofs, namespaces)
    assert sorted(r.status for r in store.runs().collect()) == ["failed", "saved", "saved"] and store.load().nodes.count() == 1


def test_events_and_outcomes(spark, tmp_path, fragments, proofs, namespaces):
    store = engine.Store(spark, str(tmp_path / "s"), "p", "set1")
    rows = [("1", "c", "t2", "GET /items", None), ("2", "c", "t1", "GET /two", None), ("3", "d", "t1", "GET /nowhere", None)]
    events = spark.createDataFrame(rows, "event_id string, capture_id string, received_at string, endpoint_id string, view_name string")
    assert store.events("c") is None
    store.append_events(events)
    store.append_events(events)
    assert [r.event_id for r in store.events("c").collect()] == ["2", "1"]
    graph, _ = assemble.merged([assemble.canonical(*f) for f in fragments], proofs, namespaces)
    assert {r.event_id: r.outcome for r in engine.observed_outcomes(graph, events).collect()} == {"1": "observed", "2": "ambiguous", "3": "unmatched"}
    store.append_events(events.withColumn("capture_id", F.lit("007")))
    assert store.events("007").count() == 3 and store.events("7").count() == 0
    laid, told = engine.overlaid(graph, events.withColumnRenamed("received_at", "timestamp"))
    gained = {r.id for r in laid.nodes.unionByName(laid.edges, allowMissingColumns=True).filter(F.exists("evidence", lambda e: e["event_id"] == "1")).filter("confidence >= 0.95").collect()}
    assert len(gained) == 2 and laid.nodes.count() == graph.nodes.count() and laid.edges.schema == graph.edges.schema
    assert {r.event_id: r.code for r in told.collect()} == {"2": "runtime_event_ambiguous", "3": "runtime_event_unmatched"}
