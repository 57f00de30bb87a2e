"""Metadata, routes, events, configuration and migration against known results."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.config import Config
from flowloom.operators import metadata, migrate
from tests.test_assemble import sha

PATHS = {
    "/": "literal", "/a/b": "literal", "/a/": "literal", "/a%20b": None, "/a%C3%A9": "literal", "/%41": None, "/a%c3%a9": None, "/a//b": None, "/a/./b": None, "/%2E%2E": None, "/a%2Fb": None,
    "/a%252Fb": None, "/a%25zz": "literal", "/a b": None, "/é": None, "/a@b": None, "/a?b": None, "a": None, "": None, None: None, "/%FF": None,
    "/x/{p0}/{p1}": "bounded", "/x/{p1}": None, "/{u0}": "unbounded", "/{u0}/{p1}": "mixed", "/x{p0}": None, "/{p32}": None,
}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    forms = {"any": None, "literal": "literal", "bounded": "bounded", "unbounded": "unbounded"}
    for r in df.select("p", *[metadata.is_contract_path(F.col("p"), v).alias(k) for k, v in forms.items()]).collect():
        want = PATHS[r.p]
        assert (r["any"], r.literal, r.bounded, r.unbounded) == (want is not None, want == "literal", want == "bounded", want == "unbounded"), r.p


@pytest.mark.parametrize(("path", "framework", "ok"), [("/a/:id", "vue", True), ("/a/:id", "django", False), ("/a/<int:pk>/", "django", True), ("/a/<pk>", "django", True), ("/a/<pk>", "react", False), ("/a/:1", "vue", False), ("/a", "rails", False)])
def test_declared_paths(spark, path, framework, ok):
    assert spark.createDataFrame([(path, framework)], "p string, f string").select(metadata.is_declared_path(F.col("p"), F.col("f")).alias("x")).first().x is ok


SCHEMA = "id string, kind string, layer string, framework_owners array<string>, method string, url_resolution string, normalized_path string, query_field_count int, has_sensitive_query boolean, endpoint_id string, reason_code string, candidate_ids array<string>, python_qualified_name string"


def test_metadata(spark):
    n = "n_" + "0" * 64
    call = ("http", None, "GET", "literal", "/a", 0, False, "GET /a", None, None, None)
    rows = [
        ("page", "page", "frontend", ["react", "vue"], *[None] * 9), ("page_order", "page", "frontend", ["vue", "react"], *[None] * 9), ("page_none", "page", "frontend", *[None] * 10),
        ("f", "function", "backend", None, *[None] * 8, "a.b"), ("f_owner", "function", "frontend", *[None] * 10), ("f_name", "function", "backend", *[None] * 9, "a"),
        ("call", "http_call", *call), ("call_path", "http_call", *call[:4], "/{p0}", *call[5:]), ("call_count", "http_call", *call[:5], 1001, *call[6:]), ("call_open", "http_call", *call[:3], "unbounded", "/{u0}", *call[5:]),
        ("call_more", "http_call", *call[:-3], "unsupported_syntax", None, None), ("call_odd", "http_call", *call[:3], "maybe", *call[4:]),
        ("un", "unresolved_target", "unresolved", *[None] * 7, "unsupported_syntax", [n], None), ("un_ids", "unresolved_target", "unresolved", *[None] * 7, "unsupported_syntax", [n, n], None), ("un_why", "unresolved_target", "unresolved", *[None] * 7, "because", None, None),
    ]
    got = {(r.id, r.rule) for r in metadata.metadata_violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        ("page_order", "framework_owners"), ("page_none", "fields_missing"), ("f_owner", "function_owners"), ("f_name", "qualified_name"), ("call_path", "call_path"), ("call_count", "counts"),
        ("call_open", "call_endpoint"), ("call_more", "fields_unknown"), ("call_odd", "call_path"), ("un_ids", "candidate_ids"), ("un_why", "reason_code"),
    }


def test_edges_and_routes(spark):
    rows = [("a", "resolves_to", "unbounded", None, None), ("b", "resolves_to", None, None, None), ("c", "carries", None, None, ["body"]), ("d", "calls", "unbounded", "x", ["body"]), ("e", "carries", None, None, [])]
    found = metadata.edge_metadata_violations(spark.createDataFrame(rows, "id string, kind string, tier string, target_repository string, payload_kinds array<string>"))
    assert {(r.id, r.rule) for r in found.collect()} == {("b", "tier"), ("d", "tier"), ("d", "target_repository"), ("d", "payload_kinds"), ("e", "payload_kinds")}
    good = sha("r_", "web", "vue", "/a", "n1")
    routes = spark.createDataFrame([(good, "web", "vue", "/a", "n1"), ("r2", "web", "django", "/b", "n1"), ("r3", "gone", "vue", "/c", "n9")], "id string, repository string, framework string, path string, node_id string")
    nodes, manifest = spark.createDataFrame([("n1", "frontend_route", "web")], "id string, kind string, repository string"), spark.createDataFrame([("web",)], "namespace string")
    assert {(r.id, r.rule) for r in metadata.route_violations(routes, nodes, manifest).collect()} == {("r2", "node_kind"), ("r2", "id"), *[("r3", x) for x in ("repository", "node", "node_kind", "node_repository", "id")]}
    twice = metadata.route_violations(routes.limit(1).union(routes.limit(1)), nodes, manifest)
    assert [r.rule for r in twice.collect()] == ["duplicate"]


def test_events(spark):
    rows = [("1", None, "c", None, None, "GET"), ("2", "old", None, "a.b", ("00-x", None), "GET")]
    df = spark.createDataFrame(rows, "event_id string, run_id string, capture_id string, view string, trace struct<traceparent:string,tracestate:string>, method string")
    got = {r.event_id: (r.capture_id, r.view_qualified_name, r.traceparent, r.legacy) for r in metadata.normalized_events(df).collect()}
    assert got == {"1": ("c", None, None, False), "2": ("old", "a.b", "00-x", True)}
    targets = {"http://localhost:80/a": "/a", "http://127.0.0.1": "/", "https://[::1]/x": "/x", "http://example.com/": None, "http://localhost/a?b": None, "http://u@localhost/": None, "ftp://localhost/": None}
    df = spark.createDataFrame([(t,) for t in targets], "t string").select("t", metadata.target_path(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == targets
    parents = {"00-" + "a" * 32 + "-" + "b" * 16 + "-01": True, "00-" + "0" * 32 + "-" + "b" * 16 + "-01": False, "00-x": False}
    df = spark.createDataFrame([(t,) for t in parents], "t string").select("t", metadata.is_trace(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == parents


def test_event_rules(spark):
    parent = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    good = {
        "event_id": "good", "capture_id": "c:1", "method": "GET", "path": "/api/a", "target": None, "endpoint_id": "GET /a", "view_qualified_name": "a.b", "status": 200, "duration_ms": 1.5,
        "traceparent": parent, "tracestate": "k=v,a/b=c d",
    }
    odd = {
        "capture_id": [None, "", "-x", "a" * 129], "method": ["get", "TRACE"], "path": ["a", "/a?b", "/a//b", "/a%2Fb", "/..", "/a%zz"], "target": ["http://example.com/api/a", "http://localhost/b"],
        "endpoint_id": ["GET /api/a", ""], "view_qualified_name": ["a", ".b"], "status": [99, 600], "duration_ms": [-1.0, float("nan"), 86_400_001.0], "traceparent": ["x"],
        "tracestate": ["", "k", "k=v=w", "K=v", "t@x=v", "secret=1", "k=é"],
    }
    rows = [good, {**good, "event_id": "bare", "target": None, "endpoint_id": None, "view_qualified_name": None, "status": None, "duration_ms": None, "traceparent": None, "tracestate": None}]
    rows += [{**good, f: v, "endpoint_id": None if f in ("path", "method") else good["endpoint_id"], "event_id": f"{f}/{i}"} | ({f: v} if f == "endpoint_id" else {}) for f, values in odd.items() for i, v in enumerate(values)]
    schema = "event_id string, " + ", ".join(f"{f} {t}" for f, t in metadata.EVENT.items())
    df = spark.createDataFrame([tuple(r[f] for f in ("event_id", *metadata.EVENT)) for r in rows], schema)
    found = {(r.id, r.rule) for r in metadata.event_violations(df, ["/api"]).collect()}
    assert found == {(f"{f}/{i}", f) for f, values in odd.items() for i in range(len(values))}
    plain = df.filter("event_id = 'good'").withColumns({"path": F.lit("/a"), "target": F.lit("http://localhost:8000/api/a")})
    assert metadata.event_violations(plain, ["/api"]).count() == 0


def test_config(tmp_path):
    c = Config.of("p", ["web=" + str(tmp_path / "a"), {"namespace": "shop", "path": str(tmp_path / "b")}, str(tmp_path / "docs")])
    assert list(c.repositories) == ["docs", "shop", "web"] and len(c.repository_set_id) == 64
    assert c.repository_set_id == Config.of("p", [f"{n}={p}" for n, p in c.repositories.items()]).repository_set_id
    assert "resolvedRoot" not in json.dumps(c.public())
    for bad in ([], ["Web=/a"], ["a=/x", "a=/y"], ["a=/x", "b=/x"]):
        with pytest.raises(ValueError, match="repositor"):
            Config.of("p", bad)


def test_migration(spark):
    node = sha("n_", "node", "p", "a.py", "function", "f")
    edge = sha("e_", "edge", node, node, "calls")
    good = {
        "project": "p", "diagnostics": [], "nodes": [{"id": node, "kind": "function", "label": "f", "layer": "backend", "source": {"path": "a.py"}, "confidence": 0.5}],
        "edges": [{"id": edge, "source": node, "target": node, "kind": "calls"}], "routes": [{"framework": "django", "path": "/a", "nodeId": node}],
    }
    odd = lambda **changes: json.dumps(good | changes)
    at = "2024-01-02 03:04:05"
    rows = [
        ("good", odd(), at), ("time", odd(), "yesterday"), ("json", "{", at), ("null", None, at), ("project", odd(project="q"), at), ("keys", odd(more=1), at),
        ("node", odd(nodes=[{**good["nodes"][0], "label": "g"}]), at), ("edge", odd(edges=[{"id": "e", "source": "a", "target": "b", "kind": "calls"}]), at), ("route", odd(routes=[{"framework": "django", "path": "/a", "nodeId": "n"}]), at),
    ]
    parsed, quarantined = migrate.snapshots(spark.createDataFrame(rows, "key string, payload string, created_at string"), "p")
    assert {r.key: r.reason for r in quarantined.collect()} == {
        "time": "invalid_timestamp", "json": "invalid_payload", "null": "invalid_payload", **dict.fromkeys(["project", "keys", "node", "edge", "route"], "legacy_incompatible"),
    }
    assert [(r.key, r.created_at) for r in parsed.collect()] == [("good", "2024-01-02T03:04:05.000Z")]
    nodes, edges, routes = migrate.converted(parsed, "p")
    assert (nodes.first().identity_key, edges.first().id, routes.first().id) == ("f", edge, sha("r_", "p", "django", "/a", node))
    cells = spark.createDataFrame([("text", b"a"), ("text", b"\xff"), ("blob", b"a")], "k string, d binary").select(migrate.text_cell(F.col("k"), F.col("d")).alias("x"))
    assert [r.x for r in cells.collect()] == ["a", None, None]
