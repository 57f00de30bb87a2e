"""Tables compared by digests of buckets, so that only what differs is looked at row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def row_hashes(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row's columns, with nulls told from absent and empty values."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def digests(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, digest): for each bucket of keys its number of rows and a digest that does not depend on their order.

    Hashes are summed, so a row that is there twice counts twice; sums are combined before the shuffle of one row a bucket.
    """
    columns = sorted(rows.columns)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    halves = [h for x in row_hashes(columns) for h in (F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    summed = [F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)]
    found = rows.select(bucket, *[h.alias(f"x{i}") for i, h in enumerate(halves)]).groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"h{i}") for i in range(len(summed))])
    return found.select("bucket", "n", F.sha2(F.concat_ws(",", "n", *[f"h{i}" for i in range(len(summed))]), 256).alias("digest"))


def total(rows: DataFrame) -> tuple[int, str]:
    """(number of rows, digest) of a whole table."""
    d = digests(rows, rows.columns[:1], 1).first()
    return (d["n"], d["digest"]) if d else (0, "")


def differences(source: DataFrame, copy: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, rule) of the rows in which ``copy`` is not ``source``: ``lost``, ``added``, ``altered`` or ``repeated`` (another number of rows).

    Both are hashed once. Buckets of equal digests are passed over; rows of the others are
    compared by key, so beyond the two scans the cost follows the differences. A null key is a key.
    """
    columns = sorted(source.columns)
    if columns != sorted(copy.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(copy.columns))}")
    mine, theirs = digests(source, keys, buckets), digests(copy, keys, buckets).toDF("bucket", "m", "other")
    unequal = mine.join(theirs, "bucket", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("bucket")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def opened(rows: DataFrame, side: str) -> DataFrame:
        inside = rows.withColumn("__bucket", bucket).join(unequal.withColumnRenamed("bucket", "__bucket"), "__bucket", "left_semi")
        first, second = row_hashes(columns)
        content = F.array_sort(F.collect_list(F.struct(first.alias("a"), second.alias("b"))))
        return inside.groupBy(*keys).agg(content.alias(side)).select(F.struct(*keys).alias(f"key_{side}"), side)

    a, b = opened(source, "mine"), opened(copy, "theirs")
    both = a.join(b, F.col("key_mine").eqNullSafe(F.col("key_theirs")), "full_outer")
    rule = (
        F.when(F.col("theirs").isNull(), "lost").when(F.col("mine").isNull(), "added")
        .when(F.array_distinct("mine") == F.array_distinct("theirs"), F.when(F.col("mine") != F.col("theirs"), "repeated")).otherwise("altered")
    )
    return both.select(F.coalesce("key_mine", "key_theirs").alias("k"), rule.alias("rule")).filter("rule is not null").select("k.*", "rule")
