"""Whether stored rows stand in their canonical order, without sorting or shuffling them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.lineage import written


def order_faults(rows: DataFrame, position: str, *keys: str) -> DataFrame:
    """(position, rule) of ``rows`` that follow another wrongly: ``unsorted`` (a smaller key), ``doubled`` (an equal one), ``out_of_place`` (not the next position).

    Rows are compared with the one before as they are read; each partition also gives its first
    and last row, and these, two rows a partition, are compared in the order of their
    positions. Keys are text, compared by code point, null first.
    """
    pairs = [c for i, k in enumerate(keys) for c in (F.col(k).isNotNull().cast("int").alias(f"has_{i}"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"key_{i}"))]
    flat = rows.select(F.col(position).cast("long").alias("position"), *pairs)

    def told(before: tuple | None, now: tuple) -> str | None:
        if before is None:
            return None
        if now[1:] <= before[1:]:
            return "doubled" if now[1:] == before[1:] else "unsorted"
        return None if now[0] == before[0] + 1 else "out_of_place"

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for batch in batches:
            out = []
            for now in batch.itertuples(index=False, name=None):
                rule = told(last, now)
                if rule:
                    out.append((now[0], rule, None, None))
                first, last = first or now, now
            yield pd.DataFrame(out, columns=["position", "rule", "first", "last"])
        if first is not None:
            as_row = lambda x: [str(v) for v in x]
            yield pd.DataFrame([(first[0], None, as_row(first), as_row(last))], columns=["position", "rule", "first", "last"])

    found = written(flat.mapInPandas(compared, "position long, rule string, first array<string>, last array<string>"))
    ends = found.filter("rule is null").withColumn("before", F.lag("last").over(W.orderBy("position")))  # one row for each partition
    key = lambda c: F.slice(c, 2, 2 * len(keys))
    place = lambda c: F.get(c, F.lit(0)).cast("long")
    later, same = key("first") > key("before"), key("first") == key("before")
    rule = F.when(F.col("before").isNull(), None).when(same, "doubled").when(~later, "unsorted").when(place("first") != place("before") + 1, "out_of_place")
    return found.filter("rule is not null").select("position", "rule").union(ends.select("position", rule.alias("rule")).filter("rule is not null"))
