"""Row numbers and running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.lineage import written


def numbered(df: DataFrame, *keys: Column | str, name: str = "rank", before: dict[str, str] | None = None, within: list[Column | str] | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with its 1-based position in the order of ``keys``, which should be total.

    ``before`` maps new columns to numeric columns of which they hold the sum over all
    rows before. Rows are dealt out by ranges of the keys and numbered within each range;
    the ranges' sizes and sums, one row for each partition, give the offsets. ``within`` is
    the order inside the ranges, where that begins with the keys and goes on. ``made`` are columns
    that it may name: they are made once for each row, after the rows were dealt, while an expression
    in ``within`` is worked out anew for each two rows that are compared.
    """
    before = before or {}
    made = made or {}
    s = df.repartitionByRange(*keys).withColumns(made).sortWithinPartitions(*(within or keys)).drop(*made)
    s = written(s.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    sizes = s.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(f"row.{c}").alias(f"sum_{new}") for new, c in before.items()])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"upto_{c}")
    starts = sizes.select(F.col("part").alias("of"), upto("n"), *[upto(f"sum_{new}") for new in before])
    # one row for each partition
    both = s.join(F.broadcast(starts), F.col("part") == F.col("of"))
    within = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = [(F.col(f"upto_sum_{new}") + F.coalesce(F.sum(f"row.{c}").over(within), F.lit(0))).alias(new) for new, c in before.items()]
    return both.select("row.*", (F.col("at") - F.shiftleft("part", 33) + F.col("upto_n") + 1).alias(name), *sums)
