"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import words
from flowloom.plans.lineage import written

BUCKETS = 10_000
#: Labelled rows that the target model is fitted on at most, about, chosen by a hash of their ids.
FITTED = 20_000
SHARE, SEED = 0.85, 11
REMEMBERED = 400_000


class Hasher:
    """Buckets of a text's words and adjacent pairs of words."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens, known = words(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in tokens:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        return (np.concatenate((h, (pairs ^ pairs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))) >> np.uint64(16)) % np.uint64(self.buckets)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all of ``texts``; tasks send one row for each bucket at most."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hasher = np.zeros(buckets, np.int64), Hasher(buckets)
        for batch in batches:
            for t in batch["text"]:
                total += np.bincount(hasher(t).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(F.col("text").cast("string")).mapInPandas(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the largest (key, doc_id), found by counting the keys' bits 16 at a time; ``key`` is a positive long."""
    base, rest = 0, k
    for shift in (48, 32, 16, 0):
        here = rows.filter(F.shiftright("key", shift + 16) == base >> (shift + 16)) if shift < 48 else rows
        counts = here.groupBy(F.shiftright("key", shift).alias("at")).count().collect()
        for r in sorted(counts, key=lambda r: -r["at"]):
            base = r["at"] << shift
            if rest <= r["count"]:
                break
            rest -= r["count"]
    ties = rows.filter(F.col("key") == base)
    return rows.filter(F.col("key") > base).union(ties.orderBy(F.desc_nulls_last("doc_id")).limit(rest)) if k else rows.limit(0)


def drawn(ratio: np.ndarray, seed: int, by_length: bool):
    """Log weight of a text, and an order-keeping long of it plus the Gumbel draw of an id, told as text."""

    @F.pandas_udf("log_weight double, key long")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(len(ratio))
        for ids, texts in batches:
            w, draws = [], []
            for doc_id, text in zip(ids, texts, strict=True):
                at = hasher(text).astype(np.int64)
                w.append(float(ratio[at].sum()) / (np.sqrt(max(1, len(at))) if by_length else 1.0))
                u = (xxhash.xxh64_intdigest(doc_id, seed) + 0.5) / 2.0**64
                draws.append(w[-1] - np.log(-np.log(u)))
            # the order of a double is that of its bits once the sign is folded in; the last bit goes to keep it positive
            b = np.array(draws, np.float64).view(np.int64)
            key = (np.where(b < 0, ~b, b ^ np.int64(-(2**63))).view(np.uint64) >> np.uint64(1)).view(np.int64)
            yield pd.DataFrame({"log_weight": w, "key": key})

    return of


def log_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = FITTED) -> np.ndarray:
    """Of each bucket the log of its probability under the target model by that under the raw one; zeros without a target."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id")).limit(most)
    raw = bucket_counts(docs, buckets)
    # at most FITTED ids
    target = bucket_counts(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), buckets)
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, most: int = FITTED, seed: int = SEED, by_length: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, log_weight, kept.

    The raw model counts the hashed words and word pairs of all texts, the target model
    those of rows labelled quality 1. log_weight is the log of the ratio of the
    probabilities that they give a whole text (``by_length``: divided by the square root of
    its n-grams, off by default). A Gumbel draw, fixed by seed and id, is added, and the
    round(share * rows) largest sums are kept, so that texts are sampled without
    replacement by their weights. Ties go to the larger id. Null and blank texts have no
    n-gram, so log_weight 0. Without a target all weights are 0. Repeated rows draw alike;
    null ids draw as -1; extra columns are ignored; an empty table gives an empty result.
    """
    ratio = log_ratio(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), buckets, most)
    doc_id = F.col("doc_id").cast("long")
    name = F.coalesce(doc_id, F.lit(-1)).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), drawn(ratio, seed, by_length)(name, F.col("text").cast("string")).alias("d"))
    keyed = written(rows.select("doc_id", "d.log_weight", "d.key", F.monotonically_increasing_id().alias("row")))
    kept = top_k(keyed.select("key", "doc_id", "row"), round(share * keyed.count())).select("row", F.lit(True).alias("kept"))
    return keyed.join(kept, "row", "left").select("doc_id", "log_weight", F.coalesce("kept", F.lit(False)).alias("kept"))
