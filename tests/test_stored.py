"""Commits of two writers, orphans, damaged tables, differences by buckets, and order without sorting."""

import json
import pathlib
import random
from collections import Counter

import pytest

from flowloom import engine
from flowloom.model import Graph
from flowloom.operators import digests, order
from flowloom.operators.assemble import EDGES, NODES
from flowloom.plans.commits import CommitLog


def graph(spark, *ids):
    return Graph(spark.createDataFrame([(i, *[None] * (len(spark.createDataFrame([], NODES).columns) - 1)) for i in ids], NODES), spark.createDataFrame([], EDGES))


def test_only_the_first_of_two_writers_commits(spark, tmp_path):
    one, two = (engine.Store(spark, str(tmp_path / "s"), "p/ü", "set") for _ in range(2))
    with pytest.raises(engine.GraphNotFound):
        one.load()
    start = one.version()
    one.save(graph(spark, "a"), start)
    with pytest.raises(engine.SnapshotConflict):
        two.save(graph(spark, "b"), start)
    assert [r.id for r in two.load(check=True).nodes.collect()] == ["a"]
    two.save(graph(spark, "b", "c"))
    assert one.version() == 2 and one.load().nodes.count() == 2 and one.load(1).nodes.count() == 1
    assert sorted(r.status for r in one.runs().collect()) == ["conflict", "saved", "saved"]
    with pytest.raises(engine.RepositorySetMismatch):
        engine.Store(spark, one.root, "p/ü", "other").load()


def test_a_crash_between_parts_leaves_the_older_snapshot_and_an_orphan(spark, tmp_path, monkeypatch):
    store = engine.Store(spark, str(tmp_path / "s"), "p", "set")
    store.save(graph(spark, "a"))
    monkeypatch.setattr(engine.digests, "total", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.save(graph(spark, "b"))
    monkeypatch.undo()
    assert [r.id for r in store.load().nodes.collect()] == ["a"]
    assert store.clean() == [] and len(store.clean(hours=-1)) == 1 and store.clean(hours=-1) == []
    assert store.load(check=True).nodes.count() == 1
    version = json.loads(CommitLog(spark, store._log().folder).read(1))["version"]
    graph(spark, "z").nodes.write.mode("overwrite").parquet(f"{store.root}/snapshots/{version}/nodes")
    with pytest.raises(engine.SnapshotDamaged):
        store.load(check=True)


def test_commits_are_whole_and_numbered(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == 0 and log.append(1, "one\ntwo") and not log.append(1, "other") and log.append(2, "")
    assert log.latest() == 2 and log.read(1) == "one\ntwo"
    assert sorted(p.name for p in pathlib.Path(tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == ["000000000001", "000000000002"]


def test_differences_name_every_row(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 == 0 else k) for k in range(300)] + [(None, "n", 1), (None, "n", 1), (400, "", None)]
    copy = [r for r in rows if r[0] != 7] + [(8, "v1", 8), (900, "x", 1), (None, "n", 1)]
    copy = [(k, "changed" if k == 20 else None if k == 400 else v, n) for k, v, n in copy]
    schema = "k long, v string, n long"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(random.Random(1).sample(copy, len(copy)), schema).repartition(3)
    for buckets in (1, 16, 1024):
        got = {r.k: r.rule for r in digests.differences(a, b.select("n", "v", "k"), ["k"], buckets).collect()}
        assert got == {7: "lost", 8: "repeated", 900: "added", 20: "altered", 400: "altered", None: "repeated"}
    assert digests.differences(a, a.repartition(5), ["k"]).count() == 0 and digests.differences(a.limit(0), a.limit(0), ["k"]).count() == 0
    assert digests.total(a) == digests.total(a.repartition(4)) != digests.total(b)
    with pytest.raises(ValueError):
        digests.differences(a, a.drop("v"), ["k"])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_order_without_sorting(spark, parts):
    keys = ["a", "b", "b", "a", "c", None, "d", "é", "z", "z", "za", "zb"]
    places = [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    rows = spark.createDataFrame(list(zip(places, keys, strict=True)), "at long, k string").repartitionByRange(parts, "at").sortWithinPartitions("at")
    want, last = Counter(), None
    order_of = lambda k: (k is not None, k or "")
    for at, k in zip(places, keys, strict=True):
        if last is not None:
            b, q = last
            rule = "doubled" if k == q else "unsorted" if order_of(k) < order_of(q) else "out_of_place" if at != b + 1 else None
            want.update([(at, rule)] if rule else [])
        last = at, k
    assert Counter(tuple(r) for r in order.order_faults(rows, "at", "k").collect()) == want
    assert order.order_faults(rows.limit(0), "at", "k").count() == 0


def test_reasons_of_legacy_snapshots_are_joined_without_their_payloads(spark):
    from flowloom.operators import migrate

    whole = '{"project":"p","diagnostics":[],"nodes":[],"edges":[],"routes":[]}'
    rows = spark.createDataFrame([("a", whole, "2024-01-02 03:04:05"), ("b", "{", "2024-01-02 03:04:05"), ("c", whole, "soon"), ("d", whole.replace('"p"', '"q"'), "2024-01-02 03:04:05"), ("e", whole.replace(',"routes":[]', ""), "2024-01-02 03:04:05")], "key string, payload string, created_at string")
    parsed, quarantined = migrate.snapshots(rows, "p")
    reasons = quarantined.select("key", "reason")
    assert {tuple(r) for r in reasons.collect()} == {("b", "invalid_payload"), ("c", "invalid_timestamp"), ("d", "legacy_incompatible"), ("e", "legacy_incompatible")}
    assert [r.key for r in parsed.collect()] == ["a"]
    plan = reasons._jdf.queryExecution().optimizedPlan().toString().splitlines()
    left = plan[next(i for i, line in enumerate(plan) if "Join LeftOuter" in line) + 1]
    assert "early#" in left and " s#" not in left and "payload#" not in left
