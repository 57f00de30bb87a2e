"""Projections of a graph: counts, flows, differences, receipts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.model import LAYERS


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def flow_layers(nodes: DataFrame, edges: DataFrame, reached: DataFrame, told: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """(layer, id, incoming, outgoing) of the nodes in ``reached`` (node): the ids of their edges, sorted, those of detached nodes included.

    Edges may be named by short keys and may be repeated: both ends of each are gathered in one pass, as keys, and
    ``told`` gives their ids, of which a list holds each once, after the last shuffle and sort.
    """
    ids = reached.select(F.col("node").alias("id"))
    shown = nodes.select("layer", "id").join(ids, "id", "left_semi")
    end = lambda name: F.struct(F.col(name).alias("id"), F.lit(name == "target").alias("enters"))
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array(end("target"), end("source"))).alias("end")).select("edge", "end.*").join(ids, "id", "left_semi")
    lists = ends.groupBy("id").agg(F.collect_list(F.when(F.col("enters"), F.col("edge"))).alias("incoming"), F.collect_list(F.when(~F.col("enters"), F.col("edge"))).alias("outgoing"))
    of = lambda name: F.coalesce(F.array_sort(F.array_distinct(F.transform(name, told))), F.array().cast("array<string>")).alias(name)
    return shown.join(lists, "id", "left").select("layer", "id", of("incoming"), of("outgoing"))


def flow_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the places of their ends' layers, which they are ordered by, and their id."""
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    s, t = nodes.select(F.col("id").alias("source"), place.alias("source_layer")), nodes.select(F.col("id").alias("target"), place.alias("target_layer"))
    return edges.join(s, "source").join(t, "target").select("source_layer", "target_layer", "id", "source", "target")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with status added, removed or changed; rows that stay the same are left out."""
    value = lambda df, name: df.select(*keys, F.struct(*[c for c in before.columns if c not in keys]).alias(name))
    both = value(before, "__a").join(value(after, "__b"), keys, "full_outer")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.withColumn("status", status).filter("status is not null").select(*keys, "status")


def receipts(items: DataFrame) -> DataFrame:
    """(id, evidence) to each observed (timestamp, event_id) with its items, sorted."""
    seen = items.select("id", F.explode("evidence").alias("e")).filter("e.kind = 'observed'")
    return seen.groupBy("e.timestamp", "e.event_id").agg(F.array_sort(F.collect_set("id")).alias("items"))
