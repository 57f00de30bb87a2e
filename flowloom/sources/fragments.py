"""Fragments of other analyzers as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.model import EVIDENCE, SOURCE

NODE = f"struct<key:string,kind:string,identity:string,label:string,layer:string,confidence:double,source:{SOURCE},evidence:{EVIDENCE}>"
EDGE = "struct<source:string,target:string,kind:string,confidence:double>"
FRAGMENT = f"adapter string, repository string, nodes array<{NODE}>, edges array<{EDGE}>, _corrupt string"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, corrupt) of the JSON fragments under ``path``; what cannot be read is kept in ``corrupt``."""
    raw = spark.read.schema(FRAGMENT).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    good = raw.filter("_corrupt is null")
    nodes = good.select("adapter", "repository", F.explode("nodes").alias("n")).select("adapter", "repository", "n.*")
    edges = good.select("adapter", "repository", F.explode("edges").alias("e")).select("adapter", "repository", "e.*")
    return nodes, edges, raw.filter("_corrupt is not null").select(F.col("_corrupt").alias("text"))
