"""Contract rules on small rows, good ones and ones broken in a single place."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from flowloom.functions import net, text
from flowloom.operators import contract


def rules(found):
    return sorted((r.id, r.rule) for r in found.collect())


def test_hosts(spark):
    good = ["a", "a.b-c.d", "1.2.3.4", "x" * 63 + ".y", "::1", "2001:db8::1", "xn--bcher-kva.example"]
    bad = ["", "A.b", "a.", ".a", "a..b", "-a", "a-", "x" * 64, "a@b", "a b", "a\n", "2001:DB8::1", "0:0::1", "fe80::1%eth0", "bücher.example", ".".join(["a" * 50] * 6), None]
    rows = spark.createDataFrame([(h,) for h in good + bad], "host string")
    got = {r.host: r.ok for r in rows.select("host", net.is_external_host(F.col("host")).alias("ok")).collect()}
    assert [h for h in good if not got[h]] == [] and [h for h in bad if got[h]] == []
    assert ipaddress.ip_address("2001:db8::1").compressed == "2001:db8::1"


def test_normal_forms(spark):
    rows = spark.createDataFrame([("ｐａｓｓｗｏｒｄ： x",), ("e\u0301",), ("plain",), (None,)], "t string")
    t = F.col("t")
    got = rows.select(text.is_secret_value(t).alias("raw"), text.is_secret_value(text.normal_form(t)).alias("secret"), text.is_normal(t).alias("nfc")).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (False, False, False), (False, False, True), (None, None, None)]


PATTERN = "id string, declared_path string, normalized_path string, endpoint_id string, converters array<struct<name:string,kind:string,segment_index:int>>"


def test_url_patterns(spark):
    two = [("pk", "int", 1), ("s", "custom", 3)]
    rows = [
        ("good", "/a/<int:pk>/b/<x:s>", "/a/{p0}/b/{p1}", "GET /a/{p0}/b/{p1}", two),
        ("none", "/a/", "/a/", "GET /a/", []),
        ("plain", "/<n>", "/{p0}", "GET /{p0}", [("n", "str", 0)]),
        ("kind", "/<int:n>", "/{p0}", "GET /{p0}", [("n", "slug", 0)]),
        ("place", "/a/<n>", "/a/{p0}", "GET /a/{p0}", [("n", "str", 0)]),
        ("twice", "/<n>/<n>", "/{p0}/{p1}", "GET /{p0}/{p1}", [("n", "str", 0), ("n", "str", 1)]),
        ("path", "/<n>", "/{p1}", "GET /{p1}", [("n", "str", 0)]),
        ("method", "/a", "/a", "get /a", []),
        ("endpoint", "/a", "/a", "GET /b", []),
        ("null", "/a", "/a", "GET /a", None),
    ]
    assert rules(contract.url_pattern_violations(spark.createDataFrame(rows, PATTERN))) == [
        ("endpoint", "endpoint"), ("kind", "converters"), ("method", "endpoint"), ("null", "converter_count"), ("null", "converter_names"),
        ("null", "converters"), ("path", "normalized_path"), ("place", "converters"), ("twice", "converter_names"),
    ]


def test_calls_and_boundaries(spark):
    calls = [
        ("good", "GET", "/a", "GET shop:/a", "shop"), ("bare", "GET", "/a", "GET /a", None), ("open", "GET", "/a", None, None),
        ("endpoint", "GET", "/a", "GET /a", "shop"), ("unknown", "GET", "/a", None, "else"), ("method", "get", "/a", None, None),
    ]
    found = contract.call_violations(
        spark.createDataFrame(calls, "id string, method string, normalized_path string, endpoint_id string, target_repository string"),
        spark.createDataFrame([("shop",)], "namespace string"),
    )
    assert rules(found) == [("endpoint", "endpoint"), ("method", "method"), ("unknown", "target_repository")]
    services = [
        ("good", "GET", "https", "a.example", None, 0, False, False, True), ("port", "GET", "https", "a.example", 0, 0, False, False, True),
        ("scheme", "GET", "ftp", "a.example", 21, 0, False, False, True), ("many", "GET", "http", "a.example", 1, 1001, True, None, True),
    ]
    schema = "id string, method string, scheme string, host string, port int, query_field_count int, path_present boolean, has_sensitive_query boolean, boundary_only boolean"
    assert rules(contract.external_violations(spark.createDataFrame(services, schema))) == [("many", "flags"), ("many", "query_field_count"), ("port", "port"), ("scheme", "scheme")]
    operations = spark.createDataFrame([("a", "get"), ("b", "raw"), ("c", None)], "id string, operation string")
    assert rules(contract.query_violations(operations)) == [("b", "operation"), ("c", "operation")]


PROOF = "call_id string, version int, normalized_path string, placeholders array<struct<token:string,segment_index:int,member_count:int,accepted_converters:array<string>>>"


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"version": 2}, ["version"]),
        ({"call_id": "literal"}, ["call", "missing"]),
        ({"normalized_path": "/b/{p0}"}, ["call"]),
        ({"placeholders": []}, ["placeholder_count", "placeholders"]),
        ({"placeholders": [("p0", 2, 2, ["int"])]}, ["placeholders"]),
        ({"placeholders": [("p0", 1, 257, ["int"])]}, ["member_count"]),
        ({"placeholders": [("p0", 1, 2, ["str", "int"])]}, ["accepted"]),
        ({"placeholders": [("p0", 1, 2, ["path"])]}, ["accepted"]),
        ({"placeholders": [("p0", 1, 5000, ["int"])]}, ["combinations", "member_count"]),
    ],
)
def test_proofs(spark, change, broken):
    calls = spark.createDataFrame([("bounded", "bounded_template", "/a/{p0}"), ("literal", "literal", "/a/{p0}")], "id string, url_resolution string, normalized_path string")
    proof = {"call_id": "bounded", "version": 1, "normalized_path": "/a/{p0}", "placeholders": [("p0", 1, 2, ["int", "str"])]} | change
    assert sorted(r.rule for r in contract.proof_violations(spark.createDataFrame([tuple(proof.values())], PROOF), calls).collect()) == broken


def test_one_proof_for_each_call(spark):
    calls = spark.createDataFrame([("a", "bounded_template", "/{p0}"), ("b", "bounded_template", "/{p0}")], "id string, url_resolution string, normalized_path string")
    proof = ("a", 1, "/{p0}", [("p0", 0, 2, ["int"])])
    assert rules(contract.proof_violations(spark.createDataFrame([proof, proof], PROOF), calls)) == [("a", "duplicate"), ("b", "missing")]


def test_resolutions(spark):
    nodes = [
        ("lit", "http_call", "web", "GET", "literal", "/a", "GET /a", None, None),
        ("bound", "http_call", "web", "GET", "bounded_template", "/{p0}", "GET shop:/{p0}", "shop", None),
        ("open", "http_call", "web", "GET", "unbounded", "/", None, None, None),
        ("body", "request_payload", "web", None, None, None, None, None, None),
        ("lone", "request_payload", "web", None, None, None, None, None, None),
        ("a", "django_url_pattern", "shop", None, None, "/a", "GET /a", None, []),
        ("p", "django_url_pattern", "shop", None, None, "/{p0}", "GET /{p0}", None, [("x", "int", 0)]),
        ("view", "django_view", "shop", None, None, None, None, None, None),
        ("none", "unresolved_target", "web", None, None, None, None, None, None),
        ("far", "external_service", "web", None, None, None, None, None, None),
    ]
    edges = [
        ("1", "lit", "a", "resolves_to", "exact_endpoint", None), ("2", "bound", "p", "resolves_to", "dynamic_converter", "shop"), ("3", "open", "none", "resolves_to", "unbounded", None),
        ("4", "body", "a", "resolves_to", "configured_base", "shop"), ("5", "lit", "body", "carries", None, None), ("6", "a", "view", "resolves_to", "declared_path", None), ("7", "lit", "far", "resolves_to", "external_boundary", None),
        ("a1", "lone", "a", "resolves_to", "exact_endpoint", None), ("a2", "lit", "p", "resolves_to", "exact_endpoint", None), ("a3", "bound", "p", "resolves_to", "exact_endpoint", "shop"),
        ("a4", "open", "a", "resolves_to", "exact_endpoint", None), ("a5", "a", "none", "resolves_to", "declared_path", None), ("a6", "bound", "far", "resolves_to", "external_boundary", None),
        ("a7", "lit", "none", "resolves_to", "unbounded", None), ("a8", "lit", "a", "resolves_to", "exact_endpoint", "web"), ("a9", "lit", "view", "resolves_to", "exact_endpoint", None),
    ]
    kinds = "id string, kind string, repository string, method string, url_resolution string, normalized_path string, endpoint_id string, target_repository string, converters array<struct<name:string,kind:string,segment_index:int>>"
    n, e = spark.createDataFrame(nodes, kinds), spark.createDataFrame(edges, "id string, source string, target string, kind string, tier string, target_repository string")
    assert rules(contract.resolution_violations(n, e)) == [
        ("a1", "owner"), ("a2", "literal_endpoint"), ("a2", "literal_path"), ("a3", "bounded"), ("a4", "unbounded"), ("a5", "pattern"),
        ("a6", "external"), ("a7", "unresolved"), ("a8", "repository"), ("a9", "target"),
    ]
    assert ("a7", "unresolved") not in rules(contract.resolution_violations(n, e, fragment=True))
