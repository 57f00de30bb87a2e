"""Faults of JSON texts by their path."""

import json

from flowloom.operators import variants

SHAPE = {"$": {"nodes": "array", "name": "string", "meta": "any?", "ok": "boolean?"}, "$.nodes[*]": {"key": "string", "at": "object?", "tags": "array?"}, "$.nodes[*].at": {"line": "number"}, "$.nodes[*].tags[*]": {"": "string"}}


def faults(spark, texts, shape, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {tuple(r) for r in variants.json_faults(rows, shape, **how).collect()}


def test_every_fault_has_its_path(spark):
    texts = [
        '{"nodes":[],"name":"a"}', '{"nodes":[{"key":"k","at":{"line":1.5}},{"key":2,"odd":1},{"at":{"line":"x"},"key":"z","tags":["a",1,null]}],"name":null,"meta":{"x":[{"y":1}]}}',
        '{"nodes":{},"extra":[1]}', "[]", "{", None, '{"name":"a","name":"b","nodes":[]}', '{"nodes":[1],"name":"\\ud800","ok":true}', "",
    ]
    assert faults(spark, texts, SHAPE) == {
        (1, "$.name", "wrong_type"), (1, "$.nodes[1].key", "wrong_type"), (1, "$.nodes[1].odd", "unknown_key"), (1, "$.nodes[2].at.line", "wrong_type"), (1, "$.nodes[2].tags[1]", "wrong_type"), (1, "$.nodes[2].tags[2]", "wrong_type"),
        (2, "$.extra", "unknown_key"), (2, "$.name", "missing_key"), (2, "$.nodes", "wrong_type"), (3, "$", "wrong_type"), (4, "$", "broken"), (5, "$", "broken"), (6, "$", "broken"), (7, "$.nodes[0]", "wrong_type"), (8, "$", "broken"),
    }
    assert faults(spark, ['{"a":{"a":{"a":1}}}'], {"$": {"a": "object"}, "$.a": {"a": "object"}, "$.a.a": {"a": "number"}}, most_levels=2) == {(0, "$.a.a", "too_deep")}


def test_snapshots_on_the_wire(spark):
    source = {"repository": "r", "path": "a.py", "line": 1}
    piece = {"kind": "inferred", "adapter": "a", "adapterVersion": "1"}
    node = {"id": "n", "kind": "page", "identityKey": "k", "label": "l", "layer": "frontend", "source": source, "evidence": [piece], "confidence": 0.5, "metadata": {"free": [1]}}
    edge = {"id": "e", "source": "n", "target": "n", "kind": "calls", "evidence": [piece], "confidence": 1, "metadata": {}}
    whole = {"schemaVersion": 2, "project": "p", "repositorySetId": "s", "repositories": [{"namespace": "r"}], "routes": [], "nodes": [node], "edges": [edge], "diagnostics": [{"id": "d", "code": "c", "severity": "error", "message": "m", "candidateIds": ["x"]}]}
    bad = whole | {"nodes": [node | {"colour": 1}, {k: v for k, v in node.items() if k != "source"}], "diagnostics": [{"id": "d", "code": "c", "severity": "error", "message": "m", "candidateIds": [1]}]}
    assert faults(spark, [json.dumps(whole), json.dumps(bad)], variants.SNAPSHOT) == {(1, "$.nodes[0].colour", "unknown_key"), (1, "$.nodes[1].source", "missing_key"), (1, "$.diagnostics[0].candidateIds[0]", "wrong_type")}
