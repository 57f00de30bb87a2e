"""Bounded templates over parts that grow in number with the members."""

from pyspark.sql import functions as F

from flowloom.operators import frontend


def test_parts_follow_the_members(spark, monkeypatch):
    monkeypatch.setattr(frontend, "ROWS", 50)
    ids = spark.range(300)
    members = ids.select("id", F.lit("p").alias("token"), F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("2"))).alias("value"))
    assert frontend.dealt_parts(members) == 18
    assert frontend.dealt_parts(members.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = frontend.bounded_templates(ids.withColumn("path", F.lit("/x/{p}")), members)
    got = found.select("id", "placeholders", F.spark_partition_id().alias("part")).collect()
    assert len(got) == 300 and {tuple(r.placeholders[0]) == (1, "p", 2, ["int", "str", "slug"]) for r in got} == {True}
    assert len({r.part for r in got}) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_domains_are_whole_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr(frontend, "ROWS", 100)
    templates = [("full", "/{p}"), ("over", "/{p}"), ("odd", "/{p}"), ("two", "/{q}/-/{p}/{q}"), ("undeclared", "/{p}/{r}"), ("unknown", "/{p}"), ("nulls", "/{p}"), ("plain", "/a"), ("loose", "/{p} /{p}"), (None, "/{p}")]
    members = [("full", "p", str(i % 4096)) for i in range(5000)] + [("over", "p", str(i)) for i in range(4097)] + [("odd", "p", str(i)) for i in range(1000)] + [("odd", "p", "a b"), ("nulls", "p", None), ("nulls", "p", "7")]
    members += [("two", "p", "0"), ("two", "p", "a/b"), ("two", "q", "0")]
    members += [(i, t, v) for i in ("undeclared", "loose", None) for t, v in (("p", "1"), (None, "1"), ("unused", "2"))]
    got = frontend.bounded_templates(spark.createDataFrame(templates, "id string, path string"), spark.createDataFrame(members, "id string, token string, value string")).collect()
    assert {r.id: [tuple(p) for p in r.placeholders] for r in got} == {
        "full": [(0, "p", 4096, ["int", "str", "slug"])],
        "odd": [(0, "p", 1001, ["str"])],
        "nulls": [(0, "p", 2, ["int", "str", "slug"])],
    }
    fits = frontend.bounded_templates(spark.createDataFrame([("two", "/{q}/-/{p}/{q}")], "id string, path string"), spark.createDataFrame([("two", "p", "x-1"), ("two", "q", "0")], "id string, token string, value string")).collect()
    assert [tuple(p) for p in fits[0].placeholders] == [(0, "q", 1, ["int", "str", "slug"]), (2, "p", 1, ["str", "slug"]), (3, "q", 1, ["int", "str", "slug"])]
