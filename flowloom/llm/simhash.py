"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.components import components
from flowloom.llm.text import words
from flowloom.plans.lineage import settled, written

BITS = 64
#: A bucket of at most so many fingerprints is compared in one task; a larger one is split by the next level of masks.
BUCKET = 512


def simhash(tokens: list[bytes], size: int = 3) -> int:
    """Bit b is set if over half of the shingles' XXH64 (seed 42) have it; no shingle gives zero."""
    if not tokens:
        return 0
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False)) if len(tokens) > size else iter([b" ".join(tokens)])
    n, ones = max(1, len(tokens) - size + 1), np.zeros(BITS, np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(42))
    for at in range(0, n, 65_536):
        part = np.fromiter(hashes, "<u8", min(65_536, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(size: int):
    """A whole text's fingerprint as a signed long. Ids stay outside: pandas would make doubles of longs beside a null."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(words(t), size) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): each whole text's fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(size)(F.col("text").cast("string")).alias("fp"))


def covering_masks(free: list[int], radius: int) -> list[int]:
    """Masks over the bit positions ``free`` such that any ``radius`` positions are all outside some mask.

    Each position gets a nonzero vector of ``radius`` + 1 bits. Any ``radius`` vectors have
    a nonzero vector orthogonal to all of them, and for each such vector there is a mask of
    the positions that are not orthogonal to it.
    """
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << bit for i, bit in enumerate(free) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def refined(mask: int, radius: int) -> list[int]:
    """Finer masks: ``mask`` and a covering of the positions that it leaves out."""
    return [mask | m for m in covering_masks([b for b in range(BITS) if not mask >> b & 1], radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(keyed: DataFrame, radius: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for mask, group in batch.groupby("mask"):
                if mask not in known:
                    known[mask] = np.unique(np.array([signed(m) for m in refined(int(mask) % (1 << 64), radius)], np.int64))
                fp, masks = group["fp"].to_numpy(), known[mask]
                wide = np.repeat(fp, len(masks)), np.tile(masks, len(fp))
                yield pd.DataFrame({"fp": wide[0], "mask": wide[1], "key": wide[0] & wide[1]})

    return keyed.select("fp", "mask").mapInPandas(rows, "fp long, mask long, key long")


def _linked(radius: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def stars(groups: pd.Series) -> pd.Series:
        """Each fingerprint with the least one of its component within the bucket."""

        def of(fps) -> list[dict[str, int]]:
            x = np.sort(np.asarray(fps, np.int64))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            root, n = np.arange(len(x)), len(x)
            while True:
                less = np.where(near, root[None, :], n).min(axis=1)
                less = np.minimum(less, less[less])
                if (less == root).all():
                    return [{"a": int(x[i]), "b": int(x[r])} for i, r in enumerate(root) if i != r]
                root = less

        return groups.map(of)

    return stars


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) over distinct fingerprints: links that connect what pairs within ``radius`` bits connect.

    All pairs within the radius meet in some bucket of the first 15 masks. Buckets of two
    are checked where they are counted. Buckets of up to ``BUCKET`` are compared in a
    task. Larger ones are split by masks that also cover the bits left out so far; each
    split leaves 7/15 of them, so that after the third any bucket has at most 2**7
    distinct members and nothing is left to cap.
    """
    masks = [signed(m) for m in covering_masks(list(range(BITS)), radius)]
    keyed = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found: list[DataFrame] = []
    while True:
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
        sizes = written(sizes)
        found.append(sizes.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 2:
            break
        crowded = sizes.filter("n > 2").select("mask", "key", "n")
        members = keyed.join(crowded, ["mask", "key"])
        small = members.filter(f"n <= {BUCKET}").groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(small.select(F.explode(_linked(radius)("fps")).alias("s")).select("s.a", "s.b"))
        if most <= BUCKET:
            break
        keyed = written(_split(members.filter(f"n > {BUCKET}"), radius).distinct())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Only ``doc_id`` and ``text`` are read; other columns, whatever their names, are
    ignored. A null or blank text has fingerprint zero and is linked like any other.
    Repeated rows give repeated rows. A null doc_id stays null and never names a
    component unless all ids of it are null. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, size))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = settled(nodes.sparkSession, lambda: components(links(nodes, radius)).toDF("fp", "root"))
    placed = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(named, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
