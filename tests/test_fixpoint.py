"""Facts by their changes, and shapes that calls hand on."""

from pyspark.sql import functions as F

from flowloom.operators import symbols
from flowloom.plans import fixpoint

FIELDS = "array<struct<name:string,type:string>>"


def test_least_distances_over_many_rounds(spark):
    arcs = [(k, k + 1, 1) for k in range(30)] + [(0, 20, 25), (5, 20, 3), (29, 3, 1)]
    edges = spark.createDataFrame(arcs, "source long, target long, w long").persist()
    step = lambda changed: changed.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("d") + F.col("w")).alias("d"))
    got = fixpoint.spread(spark.createDataFrame([(0, 0), (0, 5)], "node long, d long"), step, ["node"], {"d": F.min})
    want = {0: 0}
    for _ in range(40):
        for a, b, w in arcs:
            if a in want:
                want[b] = min(want.get(b, 10**9), want[a] + w)
    assert {r.node: r.d for r in got.collect()} == want
    assert fixpoint.spread(spark.createDataFrame([], "node long, d long"), step, ["node"], {"d": F.min}).count() == 0


def test_shapes_reach_parameters_through_calls(spark):
    functions = [("send", "send"), ("save", "save"), ("twice", "dup"), ("again", "dup"), ("loop", "loop"), ("both", "both")]
    parameters = [("send", 0, "body"), ("save", 0, "item"), ("save", 1, "other"), ("twice", 0, "x"), ("again", 0, "x"), ("loop", 0, "y"), ("both", 0, "z")]
    a, b = [("id", "number")], [("id", "number"), ("name", "string")]
    arguments = [
        ("save", None, 0, None, a), ("send", "save", 0, "item", None), ("save", "page", 1, "draft", None), ("dup", None, 0, None, a), ("loop", None, 0, None, a), ("loop", "loop", 0, "y", None),
        ("both", None, 0, None, a), ("both", "page", 0, "draft", None), ("save", "save", 7, None, a), ("gone", None, 0, None, a), ("send", "page", 0, None, []), ("save", "both", 1, "z", None) ,
    ]
    f = spark.createDataFrame(functions, "fn string, name string")
    p = spark.createDataFrame(parameters, "fn string, index int, parameter string")
    named = spark.createDataFrame([("draft", b)], f"name string, fields {FIELDS}")
    hints = symbols.payload_hints(f, p, spark.createDataFrame(arguments, f"callee string, owner string, index int, root string, fields {FIELDS}"), named)
    plain = lambda fields: [tuple(x) for x in fields]
    # both has two shapes and hands them on, so save's second parameter has no sure one either
    assert {(r.fn, r.parameter): plain(r.fields) for r in hints.collect()} == {("save", "item"): a, ("send", "body"): a, ("loop", "y"): a}
    parts = [(1, "send", "body", None, 10), (2, "page", "draft", None, 10), (3, "page", None, b, 5), (4, "both", "z", None, 1), (5, "page", "unknown", None, 1), (6, "page", "draft", None, 2)]
    deleted = [("page", "draft", "name", 5), ("send", "body", "id", 50)]
    got = symbols.request_payloads(spark.createDataFrame(parts, f"part int, owner string, root string, fields {FIELDS}, at int"), p, hints, named, spark.createDataFrame(deleted, "owner string, root string, field string, at int"))
    assert {r.part: plain(r.fields) for r in got.collect()} == {1: a, 2: a, 3: b, 4: [], 5: [], 6: b}
