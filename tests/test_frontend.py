"""Browser-source rules, JSON trees, guards and the overlay's write-back on small inputs with known results."""

import json
import math
from pathlib import Path
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom import guards
from flowloom.functions import frontend as names
from flowloom.operators import frontend, overlay, trees


def column(spark, values, of, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", of(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths_and_lines(spark):
    raw = ["a b/ü(1)*.ts", "x~y'!/z", "日本/.a"]
    assert column(spark, raw, names.encoded_path) == [quote(p, safe="/~") for p in raw]
    assert column(spark, ["a\r\nb\nc", "", "\n"], lambda v: names.line_of(v, F.char_length(v))) == [3, 1, 2]
    assert column(spark, ["/a/:id", "/a/:1", "a", "/*", "/a b", "/..", None], names.is_strict_route) == [True, False, False, False, False, False, False]
    assert column(spark, ["/*"], lambda v: names.is_strict_route(v, stars=True)) == [True]


def test_nested_routes_join_their_parents(spark):
    rows = [("a", None, "app/", False), ("b", "a", None, False), ("c", "b", ":id", False), ("d", "c", "", False), ("e", "c", "/top//x/", False), ("f", "a", None, True), ("g", None, None, True), ("h", "gone", "x", False)]
    got = dict(map(tuple, frontend.full_routes(spark.createDataFrame(rows, "id string, parent string, declared string, index boolean")).collect()))
    assert got == {"a": "/app", "b": None, "c": "/app/:id", "d": "/app/:id", "e": "/top/x", "f": "/app", "g": "/", "h": None}
    lost = [*rows, ("i", "h", "y", False), ("j", "k", "x", False), ("k", "l", "x", False), ("l", "j", "x", False), ("m", "l", "x", False)]
    lost = spark.createDataFrame(lost, "id string, parent string, declared string, index boolean")
    assert dict(map(tuple, frontend.lost_routes(lost).collect())) == {"h": "missing_parent", "i": "missing_parent", **dict.fromkeys("jklm", "circle")}
    assert frontend.full_routes(lost).count() == 13 and frontend.lost_routes(lost.limit(0)).count() == 0
    assert frontend.full_routes(spark.createDataFrame([], "id string, parent string, declared string, index boolean")).count() == 0


def test_bounded_templates_need_proof(spark):
    templates = [("a", "/x/{p0}"), ("b", "/x/{p0}/{p1}"), ("c", "/x/pre{p0}"), ("d", "/x/{p0}"), ("e", "/x")]
    members = [("a", "p0", v) for v in "123"] + [("b", t, str(i)) for t in ("p0", "p1") for i in range(65)] + [("c", "p0", "1"), ("d", "p0", "a/b")]
    got = frontend.bounded_templates(spark.createDataFrame(templates, "id string, path string"), spark.createDataFrame(members, "id string, token string, value string")).collect()
    assert [(r.id, r.placeholders[0].member_count, list(r.placeholders[0].accepted_converters), r.placeholders[0].segment_index) for r in got] == [("a", 3, ["int", "str", "slug"], 1)]


def test_modules_take_the_deepest_root(spark):
    paths = ["svc/app/views.py", "svc/app/__init__.py", "lib/x.py", "bad-dir/x.py", "svc/manage.py", "svc/bad-dir/x.py"]
    roots = spark.createDataFrame([("",), ("svc",), ("svc",)], "root string")
    got = dict(map(tuple, frontend.proved_modules(spark.createDataFrame([(p,) for p in paths], "path string"), roots).collect()))
    assert got == {"svc/app/views.py": "app.views", "svc/app/__init__.py": "app", "lib/x.py": "lib.x"}


def test_first_declarations_win(spark):
    urls = [("/a/{p0}", ["GET"], 3), ("/a/<int:pk>", ["POST"], 2), ("/b", [], 1), ("/b", ["POST"], 4), ("/c", ["PUT", "PUT"], 5)]
    got = frontend.first_endpoints(spark.createDataFrame(urls, "path string, methods array<string>, ordinal int")).collect()
    assert {tuple(r) for r in got} == {("POST", "/a/<int:pk>", 2), ("GET", "/b", 1), ("PUT", "/c", 5)}
    rows = [("k", 0.5, 1), ("k", 0.9, 3), ("k", 0.9, 2), ("m", 0.1, 9)]
    assert {tuple(r) for r in frontend.most_confident(spark.createDataFrame(rows, "key string, confidence double, ordinal int")).collect()} == {("k", 0.9, 2), ("m", 0.1, 9)}


def test_trees(spark):
    secret = "abcdefgh" * 5
    texts = [{"a": [{"b": {"password": 1}}]}, {"hasSensitiveQuery": True}, {"x": [secret]}, {"source": secret}, {"token": "t"}, {"id": "n_" + "a" * 64}, {"kind": "observed"}, {"a": {"runId": None}}]
    raw = [*map(json.dumps, texts), "{cut", None]
    found = lambda rule: column(spark, raw, lambda v: rule(trees.entries(v)))
    assert found(trees.holds_secret) == [True, False, True, True, True, True, False, False, None, None]
    assert found(trees.fragment_secret) == [True, False, True, False, False, False, False, False, None, None]
    assert found(trees.holds_runtime_material) == [False] * 6 + [True, True, None, None]
    value = {"b": [1.5, {"z": None, "ü": "日"}], "a": {"Cookie": 1, "sessionId": [2], "ok": "x"}}
    texts = [json.dumps(value), '{"x": NaN}']
    half = ['{"a":"\\ud800"}', '["\\uDFFF\\ud800"]', '{"\\ud83d\\ude00":1}']
    assert column(spark, half, trees.canonical) == column(spark, half, trees.redacted) == [None, None, '{"\U0001f600":1}']
    assert column(spark, half, lambda v: F.size(trees.entries(v))) == [-1, -1, 2] or column(spark, half, lambda v: trees.entries(v).isNull()) == [True, True, False]
    assert column(spark, texts, trees.canonical) == [json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None]
    assert json.loads(column(spark, texts, trees.redacted)[0]) == {"b": value["b"], "a": {"ok": "x"}}


def test_guards(tmp_path):
    (tmp_path / "work" / "app").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "work" / "link").symlink_to(tmp_path / "out")
    (tmp_path / "work" / "file").touch()
    work = tmp_path / "work"
    assert guards.analysis_root(work, "app") == work / "app" and guards.analysis_root(work, tmp_path / "out") == tmp_path / "out"
    for bad in ("", "../out", "app/..", "%2e%2e/out", "%252e%252e/out", "a%2fb", "a\\b", "link", "gone", "file", "/", str(Path.home() / ".ssh")):
        with pytest.raises(guards.RootError):
            guards.analysis_root(work, bad)
    assert guards.sensitive_settings({"api_token": "x", "password": "", "name": 1, "body": 2}) == ["api_token", "body"]
    assert guards.sensitive_settings({"api_token": "x"}, approved=True) == []
    a, b = StructType.fromDDL("x int, y string, w int"), StructType.fromDDL("x long, y string, z int")
    assert guards.schema_faults(a, b) == ["missing z", "type x", "unknown w"] and guards.schema_faults(b, b) == []


def test_overlay_writes_back_what_fits(spark):
    urls, views = [("u1", "e1"), ("u2", "e2"), ("u3", "e2"), ("u4", "e4")], [("v1", "name"), ("v2", "twice"), ("v3", "twice")]
    links, calls = [("u1", "v1", "l1")], [("u1", "c1", "s1"), ("u4", "c2", "s2"), ("u4", "c3", "s3")]
    events = [(i, f"t{i:02}", "e1", "name") for i in range(5)] + [(5, "t05", "e1", None), (6, "t06", "e2", None), (7, "t07", "e4", None), (8, "t08", "e9", None), (9, "t09", "e4", "name"), (10, "t10", "e1", "twice")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    u, v = df(urls, "url string, endpoint_id string"), df(views, "view string, view_name string")
    li, c = df(links, "url string, view string, link string"), df(calls, "url string, edge string, source string")
    matched = overlay.match(df(events, "event_id int, timestamp string, endpoint_id string, view_name string"), u, v, li, c)
    assert {r.event_id: r.outcome for r in matched.collect()} == {**dict.fromkeys(range(6), "observed"), 6: "ambiguous", 7: "ambiguous", 8: "unmatched", 9: "conflict", 10: "ambiguous"}
    items = df([("u1", 30, 0.5), ("v1", 0, 0.99), ("l1", 32, 0.5), ("c1", 1, 0.5), ("u2", 1, 0.5)], "id string, n_evidence int, confidence double")
    evidence, after = overlay.written_back(matched.filter("outcome = 'observed'"), li, items)
    assert sorted((r.id, r.event_id) for r in evidence.collect()) == sorted([("u1", 0), ("u1", 1), *[("v1", i) for i in range(5)], *[("c1", i) for i in range(6)]])
    assert {r.id: (r.n_evidence, r.confidence) for r in after.collect()} == {"u1": (32, 0.95), "v1": (5, 0.99), "l1": (32, 0.5), "c1": (7, 0.95), "u2": (1, 0.5)}
    told = {r.event_id: (r.code, r.candidates) for r in overlay.event_diagnostics(matched, u, v, c).collect()}
    assert told == {
        6: ("runtime_event_ambiguous", ["u2", "u3"]), 7: ("runtime_event_ambiguous", ["s2", "s3"]), 8: ("runtime_event_unmatched", None),
        9: ("runtime_identity_conflict", ["u4", "v1"]), 10: ("runtime_event_ambiguous", ["u1", "v2", "v3"]),
    }
    assert math.isclose(after.agg(F.sum("confidence")).first()[0], 0.95 + 0.99 + 0.5 + 0.95 + 0.5)


def test_items_of_the_overlay_are_made_once_and_by_many_tasks(spark):
    from flowloom import queries_frontend

    links = queries_frontend._overlay(spark, "/root/testdata/sf0.001")[3]
    assert links.rdd.getNumPartitions() > 1
    assert queries_frontend._overlay(spark, "/root/testdata/sf0.001")[1].rdd.getNumPartitions() == 1  # customers are one part of a file
    rows = lambda n: "c_custkey" in n
    after = queries_frontend.overlay_write_back(spark, "/root/testdata/sf0.001")
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert sum("customer.parquet" in line or rows(line) and "Relation" in line for line in plan.splitlines()) == 2  # as URLs and in links


def test_what_fits_of_new_evidence_is_a_number(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    observed = df([("u", "v", "e", "n", f"t{i}", i) for i in range(6)], "url string, view string, edge string, view_name string, timestamp string, event_id int")
    items = df([("u", n, 0.5) for n in (0, 27, 30, 32, 40, None)], "id string, n_evidence int, confidence double")
    for item in items.collect():
        evidence, after = overlay.written_back(observed, df([], "url string, view string, link string"), df([item], items.schema))
        fits = 0 if item.n_evidence is None else max(0, min(6, 32 - item.n_evidence))
        assert [r.event_id for r in evidence.orderBy("event_id").collect()] == list(range(fits))
        assert [tuple(r) for r in after.collect()] == [("u", None if item.n_evidence is None else item.n_evidence + fits, 0.95 if fits else 0.5)]
