"""URL targets, constants, shapes and guidance against known results."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions import urls
from flowloom.operators import remediate, symbols

CASES = [
    ("/a/b", ("/a/b", 0, False, None, None, None, None)),
    ("/a?x=1&accessToken=2&&y", ("/a", 3, True, None, None, None, None)),
    ("/a?tokens=1", ("/a", 1, False, None, None, None, None)),
    ("//host/a", None), ("/a#b", None), ("/a/../b", None), ("/a%2Fb", None), ("/a%zz", None), ("/a b", None), ("/a{x}", None), ("/é", None), ("", None), (None, None),
    ("https://Ex.com/p?q=1", ("/", 1, False, "https", "ex.com", None, True)),
    ("http://ex.com:80", ("/", 0, False, "http", "ex.com", None, False)),
    ("http://ex.com:8080/", ("/", 0, False, "http", "ex.com", 8080, False)),
    ("https://[::1]/x", ("/", 0, False, "https", "::1", None, True)),
    ("http://ex.com:0/", None), ("http://ex.com:70000/", None), ("http://u:p@ex.com/", None), ("http://ex.com/#x", None), ("http://bad_host/", None), ("ftp://ex.com/", None), ("https://ex.com./", None),
    ("items/1", None),
]


def test_targets(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "u string").select("u", urls.url_target(F.col("u")).alias("t"))
    assert {r.u: tuple(r.t) if r.t else None for r in df.collect()} == dict(CASES)


@pytest.mark.parametrize(("value", "base", "path"), [("items/1", "/api/", "/api/items/1"), ("items", "/", "/items"), ("a//b", "/api", None), ("../a", "/api", None), ("a", "api", None), ("a?b", "/api", None), ("/x", "/api", "/x")])
def test_base(spark, value, base, path):
    got = spark.createDataFrame([(value,)], "u string").select(urls.url_target(F.col("u"), base)["normalized_path"].alias("x")).first().x
    assert got == path


@pytest.mark.parametrize(("head", "path"), [("/a/b", "/a/{u0}"), ("/a/", "/a/{u0}"), ("x", "/{u0}"), ("/", "/{u0}"), ("", "/{u0}"), (None, "/{u0}")])
def test_unbounded(spark, head, path):
    assert spark.createDataFrame([(head,)], "h string").select(urls.unbounded_path(F.col("h")).alias("x")).first().x == path


def test_constants(spark):
    rows = [("A", None, "/api"), ("B", "A", "/items"), ("C", "B", None), ("D", None, "/x"), ("D", None, "/y"), ("E", "D", "/z"), ("F", None, "plain"), ("G", "G", "/loop"), ("H", "missing", "/q"), ("A", None, "/api"), (None, None, "/n"), ("I", None, "/i"), ("I", "J", "/k"), ("J", "I", "/j")]
    got = symbols.url_constants(spark.createDataFrame(rows, "name string, ref string, text string"))
    assert {(r.name, r.url) for r in got.collect()} == {("A", "/api"), ("B", "/api/items"), ("C", "/api/items")}
    assert symbols.url_constants(spark.createDataFrame([], "name string, ref string, text string")).count() == 0


def test_a_long_chain_of_url_constants(spark):
    rows = [("c0", None, "/x")] + [(f"c{k}", f"c{k - 1}", None) for k in range(1, 12)]
    assert symbols.url_constants(spark.createDataFrame(rows, "name string, ref string, text string")).count() == 12


def test_shapes(spark):
    rows = [("p", 1, 0, "a", "int"), ("p", 1, 1, "b", "str"), ("p", 2, 0, "b", "str"), ("q", 3, 0, "a", "int"), ("q", 4, 0, "z", "int"), ("r", 5, 0, "a", "int"), ("r", 6, 0, "a", "int")]
    got = symbols.payload_shapes(spark.createDataFrame(rows, "name string, shape int, ordinal int, field string, type string"))
    assert {r.name: [tuple(f) for f in r.fields] for r in got.collect()} == {"p": [("a", "int"), ("b", "str")], "r": [("a", "int")]}


def test_cards(spark):
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    rows = [
        ("1", "url_target_ambiguous", "n1", None, ["n9", "n3", "n2"]), ("2", "url_target_unmatched", "gone", "e1", None), ("3", "unsupported_syntax", None, "e1", []),
        ("4", "no_such_code", "n1", None, None), ("5", "runtime_capture_empty", None, None, None),
    ]
    d = spark.createDataFrame(rows, "id string, code string, node_id string, edge_id string, candidate_ids array<string>")
    got = {r.key: (r.source, r.focus_type, r.focus_id) for r in remediate.diagnostic_cards(d, ids("n1", "n2", "n3"), ids("e1")).collect()}
    assert got == {
        "diagnostic:1": ("Diagnostic: url target ambiguous", "node", "n2"), "diagnostic:2": ("Diagnostic: url target unmatched", None, None),
        "diagnostic:3": ("Diagnostic: unsupported syntax", "edge", "e1"), "diagnostic:5": ("Diagnostic: runtime capture empty", None, None),
    }
    items = spark.createDataFrame([("n1", [("unresolved", "unsupported_syntax"), ("inferred", "ast_call")])], "id string, evidence array<struct<kind:string,reason:string>>")
    assert [r.key for r in remediate.evidence_cards(items, "node").collect()] == ["evidence:node:n1:unsupported_syntax"]
