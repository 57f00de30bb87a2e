import os
import subprocess
import sys
from pathlib import Path

from flowloom.plans.lineage import scratch, settled, written
from flowloom.plans.ranking import numbered


def test_written_keeps_rows_and_types(spark):
    df = spark.range(5).toDF("k")
    again = written(df)
    assert again.dtypes == df.dtypes and sorted(r.k for r in again.collect()) == [0, 1, 2, 3, 4]
    assert written(df.limit(0)).count() == 0


def test_written_without_a_preset_folder(tmp_path):
    """In a process of its own: a local session gets a folder, a cluster's has to name one."""
    code = """
from pyspark.sql import SparkSession
from flowloom.plans import lineage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = lineage.written(spark.range(3))
assert df.count() == 3 and lineage.shared_folder(spark) == lineage.shared_folder(spark)
lineage.cleared(spark)
class Far:
    conf = spark.conf
    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
try:
    lineage.shared_folder(Far)
except ValueError as e:
    assert "spark.checkpoint.dir" in str(e)
    print("fine")
"""
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_numbered_with_running_sums(spark):
    rows = [(i * 37 % 101, i % 5) for i in range(101)]
    got = sorted((r.at, r.k, r.less) for r in numbered(spark.createDataFrame(rows, "k int, v int").repartition(5), "k", name="at", before={"less": "v"}).collect())
    want, total = [], 0
    for at, (k, v) in enumerate(sorted(rows), 1):
        want.append((at, k, total))
        total += v
    assert got == want
    assert numbered(spark.range(0), "id").count() == 0


def test_tables_on_the_way_are_deleted(spark):
    on_the_way = []

    def make():
        on_the_way.append(written(spark.range(4)))
        return settled(spark, lambda: on_the_way[0].filter("id > 0")).filter("id > 1")

    with scratch(spark):
        out = settled(spark, make)
        assert sorted(r.id for r in out.collect()) == [2, 3]
        files = [f.removeprefix("file://") for f in out.inputFiles()]
        assert not any(os.path.exists(f.removeprefix("file://")) for f in on_the_way[0].inputFiles()) and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))
