"""Trees with links, ignored, unreadable and large files; evidence of a stream across restarts."""

import os
import random

import pytest

from flowloom.operators import overlay
from flowloom.sources import syntax, tree
from flowloom.streaming import overlay as stream


def test_trees_are_pruned_and_failures_are_rows(spark, tmp_path):
    root = tmp_path / "r"
    put = {"a.py": "x = 1", "b/c (1).py": "y", "b/d/ü.py": "# coding: latin-1\nz = 'é'", "b/node_modules/n.py": "no", "e/out/f.py": "py only", "e/app.vue": "<a/>", "e/g.ts": "t", "big.py": "#" * 3000, "e/.git/h.py": "no"}
    for name, text in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.py").write_bytes(b"a = '\xff'")
    (root / "link").symlink_to(root / "b")
    (root / "link.py").symlink_to(root / "a.py")
    spark.dataSource.register(tree.SourceTree)
    for partitions in (1, 4, 64):
        rows = spark.read.format("source_tree").option("mostBytes", 2000).option("partitions", partitions).load(str(root)).collect()
        assert sorted((r.path, r.status) for r in rows) == sorted([("a.py", "ok"), ("b/c (1).py", "ok"), ("b/d/ü.py", "ok"), ("e/out/f.py", "ok"), ("bad.py", "ok"), ("big.py", "source_read_failed")])
    assert {r.path: r.encoded for r in rows}["b/c (1).py"] == "b/c%20%281%29.py"
    files, faults = tree.read_sources(spark, str(root))
    texts = {r.path: r.text for r in files.collect()}
    assert texts["bad.py"] == "a = '�'" and texts["b/d/ü.py"].endswith("z = 'é'") and faults.count() == 0
    assert not {r.kind for r in syntax.python_places(files).collect()} & {"unsupported_syntax"} or len(texts) == 6
    front, _ = tree.read_sources(spark, str(root), "frontend")
    assert {r.path for r in front.collect()} == {"e/app.vue", "e/g.ts"}
    with pytest.raises(Exception, match="link"):
        spark.read.format("source_tree").load(str(root / "link")).collect()


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads every folder")
def test_unreadable_folders_are_rows(spark, tmp_path):
    (tmp_path / "shut").mkdir(mode=0)
    assert [(r.code, r.path) for r in tree.read_sources(spark, str(tmp_path))[1].collect()] == [("source_read_failed", "shut")]


def test_a_folder_that_is_gone_is_a_row(spark, tmp_path):
    reader = tree._Reader({"path": str(tmp_path)})
    assert [r[4] for r in reader.read(tree.Folder(str(tmp_path / "gone"), True))] == ["source_read_failed"]


def test_streamed_evidence_is_capped_as_in_a_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"t{rnd.randint(0, 3)}", rnd.choice(["a", "b"]), None if k % 17 == 0 else f"{rnd.randint(0, 60):02}", f"{k % 5}") for k in range(300)] + [("one", "a", "1", "1")] * 3
    schema = "id string, reason string, event_id string, timestamp string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, part in enumerate((rows[:120], rows[120:], [("t0", "A", "000", "late")])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            told = stream.first_pieces(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 8)
            keep = lambda batch, at: batch.write.mode("append").parquet(str(tmp_path / "out"))
            q = told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
            # each turn is a stream of its own that starts from the checkpoint of the one before
            got = sorted(map(tuple, stream.settled_pieces(spark.read.parquet(str(tmp_path / "out"))).collect()), key=repr)
            everything = spark.read.parquet(str(tmp_path / "in"))
            want = sorted((tuple(r) for r in overlay.capped(everything, "id", "reason", "event_id", "timestamp", most=8).select("id", "reason", "event_id", "timestamp").collect()), key=repr)
            assert got == want and len(want) > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
