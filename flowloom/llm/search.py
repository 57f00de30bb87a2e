"""Ranked lexical search: the best documents of each item under an integer term weighting, by a threshold-seeded join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.lineage import settled, written

#: Documents returned for an item.
BEST = 10
#: Terms whose bounds sum to less than this share of an item's threshold are looked up only for candidates.
LATER = 0.5
#: Terms of a batch that a task hands over at once.
TOGETHER = 200_000

#: A-Z lower-cased; ASCII other than letters and digits is a border; bytes from 128 on belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def term_rows(texts: DataFrame) -> DataFrame:
    """(row, id, n, term, tf) of ``texts`` (row, id, text): each distinct term of a text of ``n`` terms.

    Each text, also one without terms, has one more row: of the empty term, with tf = n and the text's id,
    which the other rows leave null.
    """

    def handed(rows: list[tuple], found: list[Counter], schema: pa.Schema) -> pa.RecordBatch:
        sizes, n = np.array([len(c) for c in found]), np.array([c[b""] for c in found], np.int64)
        heads = np.zeros(sizes.sum(), bool)
        heads[np.concatenate([[0], sizes.cumsum()[:-1]])] = True  # the empty term was put in first
        ids = np.zeros(len(heads), object)
        ids[:] = None
        ids[heads] = [i for _, i in rows]
        columns = [
            pa.array(np.repeat(np.array([r for r, _ in rows], np.int64), sizes)), pa.array(ids, pa.int64()), pa.array(np.repeat(n, sizes)),
            pa.array([t for c in found for t in c], pa.binary()), pa.array(np.fromiter((f for c in found for f in c.values()), np.int64, len(heads))),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("term", pa.binary()), ("tf", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, size = [], [], 0
            for row, doc, text in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), batch["text"], strict=True):
                all_ = terms(text.as_py())
                rows.append((row, doc))
                found.append(Counter({b"": len(all_)}))
                found[-1].update(all_)
                size += len(found[-1])
                if size > TOGETHER:
                    yield handed(rows, found, schema)
                    rows, found, size = [], [], 0
            if rows:
                yield handed(rows, found, schema)

    text = F.col("text").cast("string").cast("binary").alias("text")
    return texts.select("row", "id", text).mapInArrow(counted, "row long, id long, n long, term binary, tf long")


def _best(df: DataFrame, by: str, score: str, most: int, *ties: str) -> DataFrame:
    order = [F.desc(score), *[F.asc_nulls_last(c) for c in ties]]
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most)


def _totals(pairs: DataFrame, asked: DataFrame, impacts: DataFrame) -> DataFrame:
    """(item, row, impact) for each of ``pairs`` (item, row) and each of the item's ``asked`` terms (item, tid) that the row holds."""
    return pairs.select("item", "row").join(asked.select("item", "tid"), "item").join(impacts, ["row", "tid"]).select("item", "row", "impact")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, later: float = LATER) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents with a score above 0 for each row of ``items`` (item_id, text).

    A term's impact in a document is its part of the score. Of each term the documents of
    the ``best`` highest impacts are stored: the last of them bounds the item's k-th score
    from below, and the exact scores of all stored documents of the item's terms, which
    are at least that, raise the threshold. Terms are then taken by their highest impact,
    the least first, while these sum to under ``later`` of the threshold: a document with
    none of the other terms can't reach it, so the other terms' postings give all
    candidates. Those that could reach the threshold with the terms left are scored
    exactly. No candidate is capped, and scores at the threshold stay, so ties are whole.

    Null and empty texts have no terms and are in no result; an item without known terms
    has no rows. A repeated document or item counts for each of its rows, with equal ids
    in any order; equal scores go by id, null ids last. Very long texts are read whole.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    asked_rows = written(items.select(number.alias("row"), F.col("item_id").cast("long").alias("id"), "text"))
    asked = written(term_rows(asked_rows).select(F.col("row").alias("item"), "term"))
    empty = F.lit(b"")
    vocabulary = written(asked.filter(F.col("term") != empty).select("term").distinct().withColumn("tid", number))
    known = vocabulary.union(spark.createDataFrame([(b"", -1)], vocabulary.schema))
    asked = written(asked.join(vocabulary, "term").select("item", "tid"))

    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    postings = written(term_rows(rows).join(known, "term").select("row", "id", "n", "tid", "tf"))
    heads = postings.filter("tid = -1").select("row", "id", "n")
    total = heads.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    def weighed() -> DataFrame:
        n = F.lit(total["docs"])
        df = postings.filter("tid >= 0").groupBy("tid").agg(F.count("*").alias("df"))
        weights = df.select("tid", F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1))).alias("w"))
        m = F.expr(f"100 - 90 + (90 * n * {total['docs']}L) div {max(total['terms'], 1)}L")
        return postings.filter("tid >= 0").withColumn("m", m).join(weights, "tid").select("row", "tid", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("impact"))

    impacts = settled(spark, weighed)
    stored = written(_best(impacts, "tid", "impact", best, "row"))
    bounds = stored.groupBy("tid").agg(F.max("impact").alias("top"), F.max(F.when(F.col("rank") == best, F.col("impact"))).alias("kth"))
    bounded = written(asked.join(bounds, "tid"))

    seeds = asked.join(stored, "tid").select("item", "row").distinct()
    seeded = _best(_totals(seeds, asked, impacts).groupBy("item", "row").agg(F.sum("impact").alias("score")), "item", "score", best, "row")
    raised = seeded.filter(F.col("rank") == best).select("item", F.col("score").alias("reached"))
    least = bounded.groupBy("item").agg(F.max("kth").alias("kth")).join(raised, "item", "left")
    # 1 is the least score that counts
    least = written(least.select("item", F.greatest(F.lit(1), F.coalesce("kth", F.lit(1)), F.coalesce("reached", F.lit(1))).alias("least")))

    summed = F.sum("top").over(W.partitionBy("item").orderBy("top", "tid").rowsBetween(W.unboundedPreceding, 0))
    split = written(bounded.join(least, "item").withColumn("later", summed < F.col("least") * later))
    rest = split.groupBy("item", "least").agg(F.coalesce(F.sum(F.when(F.col("later"), F.col("top"))), F.lit(0)).alias("rest"))
    first = split.filter(~F.col("later")).select("item", "tid").join(impacts, "tid").groupBy("item", "row").agg(F.sum("impact").alias("impact"))
    able = written(first.join(rest, "item").filter(F.col("impact") + F.col("rest") >= F.col("least")).select("item", "row", "impact"))
    exact = able.union(_totals(able, split.filter("later"), impacts)).groupBy("item", "row").agg(F.sum("impact").alias("score"))
    reached = written(exact.join(least, "item").filter("score >= least").select("item", "row", "score"))
    named = reached.join(heads.select("row", F.col("id").alias("doc_id")), "row").join(asked_rows.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item")
    return _best(named, "item", "score", best, "doc_id", "row").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
