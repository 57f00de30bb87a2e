"""Stored tables: latest-wins upserts, insert-or-ignore, routing into quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it has no key of."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the largest version of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(rows.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` and, for keys it lacks, the first row of ``new`` in ``order``."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def routed(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``rows`` with the first reason that holds, in the order given; null rows are migrated."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return rows.withColumn("reason", out)


def accounted(source: DataFrame, migrated: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """One row: how many source keys, how many in either table, how many in both, how many in none."""
    flags = (
        source.select(key).distinct()
        .join(migrated.select(key).distinct().withColumn("m", F.lit(1)), key, "left")
        .join(quarantined.select(key).distinct().withColumn("q", F.lit(1)), key, "left")
    )
    return flags.agg(
        F.count("*").alias("n_source"), F.count("m").alias("n_migrated"), F.count("q").alias("n_quarantined"),
        F.count(F.when(F.col("m").isNotNull() & F.col("q").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("m").isNull() & F.col("q").isNull(), 1)).alias("n_lost"),
    )


def append_events(events: DataFrame, stored: DataFrame, path: str, by: tuple[str, ...] = ("project", "repository_set_id", "capture_id")) -> None:
    """Append events whose id is not stored yet in their scope; only the scopes that ``events`` names are read."""
    scopes = events.select(*by).distinct()
    known = stored.join(scopes, list(by), "left_semi").select(*by, "event_id")
    new = events.dropDuplicates([*by, "event_id"]).join(known, [*by, "event_id"], "left_anti")
    new.write.mode("append").partitionBy(*by).parquet(path)
