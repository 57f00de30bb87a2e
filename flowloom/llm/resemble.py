"""Groups of rows whose texts resemble each other: bands of least shingle hashes, then the exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.components import components
from flowloom.llm.decontaminate import shingles
from flowloom.llm.text import words
from flowloom.plans.lineage import written

SIZE, SIMILAR = 5, 0.8
#: Independent fingerprints of a text, and least hashes in each; texts of similarity s share none with chance (1 - s**4)**20, 3e-5 at 0.8.
BANDS, LEAST = 20, 4

_RND = np.random.default_rng(42)
_TIMES = _RND.integers(0, 2**63, BANDS * LEAST, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RND.integers(0, 2**63, BANDS * LEAST, np.uint64)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of ``size`` words as sorted hashes; a shorter text is one shingle, one without words has none."""
    return np.unique(np.array(shingles(words(text), size), np.uint64))


def fingerprints(hashes: np.ndarray) -> list[int]:
    """One signed long for each band: a hash of its least shingle hashes under as many orders."""
    if not len(hashes):
        return []
    least = np.full(len(_TIMES), 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, a : a + 1024] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - 2**63 for k, b in enumerate(least.reshape(BANDS, LEAST))]


def links(docs: DataFrame, nodes: DataFrame, size: int, similar: float) -> DataFrame:
    """(a, b) over ``nodes`` (node, bands): links that connect what pairs of a shared band and of ``similar`` or more connect.

    First each node is compared with the least node of each of its bands: as many pairs
    as bands at most, which already connect most of a large group of near copies. Where
    the nodes of a band are still in several pieces, they join the nodes of all such bands
    in an index of their rarest shingles: each is compared with one other text of each of its
    shingles there, and then all pairs that are still apart and could be similar. Bands of two nodes are settled by the first step.
    """
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    keyed = written(keyed.join(shared, "key"))
    pairs = written(keyed.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())

    @F.pandas_udf("array<long>")
    def shingled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, size).view(np.int64))

    wanted = keyed.select(F.col("node").alias("row")).distinct()
    members = docs.select("row", F.col("text").cast("string").alias("text")).join(wanted, "row", "left_semi")
    sets = written(members.select(F.col("row").alias("node"), shingled("text").alias("found")))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("fa", "fb"))
        found = pairs.join(sets.toDF("a", "fa"), "a").join(sets.toDF("b", "fb"), "b")
        return found.filter(both / (F.size("fa") + F.size("fb") - both) >= similar).select("a", "b")

    star = written(similar_pairs(pairs))
    opened = _open(keyed, star).select("node", "piece").distinct()
    index = _rarest(opened.join(sets, "node"), similar)
    first = index.groupBy("h").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("piece").alias("other")), F.xxhash64("node")).alias("first"))
    drawn = index.join(first, "h").select("node", "piece", "first.*").filter("piece <> other").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    star = written(star.union(similar_pairs(written(drawn))))
    placed = index.drop("piece").join(components(star).toDF("node", "piece"), "node", "left").withColumn("piece", F.coalesce("piece", "node"))
    return similar_pairs(_could_resemble(written(placed), similar)).union(star)


def _open(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, piece): the nodes of all bands of three or more that the links ``found`` leave in several pieces."""
    piece = components(found).toDF("node", "piece")
    placed = written(keyed.filter("n > 2").select("key", "node").join(piece, "node", "left").withColumn("piece", F.coalesce("piece", "node")))
    still = placed.groupBy("key").agg(F.min("piece").alias("one"), F.max("piece").alias("other")).filter("one <> other").select("key")
    return written(placed.join(still, "key"))


def _rarest(members: DataFrame, similar: float) -> DataFrame:
    """(h, node, piece, n, at): the first (1 - ``similar``) shingles of each of ``members`` (node, piece, found), the rarest first, that others have as well."""
    each = written(members.select("node", "piece", F.size("found").alias("n"), F.explode("found").alias("h")))
    shared = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(shared, "h").withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("df", "h")))
    # shingles of one text alone stand before all others
    alone = ranked.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("both")).select("node", (F.col("n") - F.col("both")).alias("alone"))
    first = ranked.join(alone, "node").withColumn("at", F.col("at") + F.col("alone")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1)
    return written(first.select("h", "node", "piece", "n", "at"))


def _could_resemble(index: DataFrame, similar: float) -> DataFrame:
    """(a, b): all pairs of different pieces in ``index`` that can have a Jaccard similarity of ``similar``.

    Take the shingles of all sets in one order, the rarest first. Sets of a similarity s
    share one of the first (1 - s) of their shingles, and neither is larger than the
    other's size over s; after the first that they share enough must be left of both. So an
    index of these first shingles finds every pair. What many texts have in common stands
    last and is in no index, unless a text holds little else.
    """
    a, b = (index.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "piece", "n", "at")]) for side in "ab")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    sizes = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similar - 1e-9) & (left * (1 + similar) >= (F.col("n_a") + F.col("n_b")) * similar - 1e-9)
    return a.join(b, "h").filter((F.col("node_a") < F.col("node_b")) & (F.col("piece_a") != F.col("piece_b")) & sizes).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def resemblance_groups(docs: DataFrame, size: int = SIZE, similar: float = SIMILAR) -> DataFrame:
    """(row, component) for each row of ``docs`` (row, text): rows connected by texts of ``similar`` or more.

    The similarity is the exact Jaccard similarity of the sets of ``size``-word shingles,
    words lower-cased A-Z. Texts of the same words are one node, texts without words
    included. Nodes that share one of 20 fingerprints are candidates; no bucket is capped,
    and what is not linked already is found by its rarest shingles.
    """

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [xxhash.xxh3_128_digest(b" ".join(words(t))) for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "name": names, "bands": [fingerprints(shingle_set(t, size)) for t in batch["text"]]})

    rows = written(docs.select("row", F.col("text").cast("string")).mapInPandas(sketched, "row long, name binary, bands array<long>"))
    nodes = written(rows.groupBy("name").agg(F.min("row").alias("node"), F.first("bands").alias("bands")))
    roots = components(links(docs, nodes, size, similar))
    named = nodes.select("name", "node").join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("component"))
    return rows.select("row", "name").join(named, "name").select("row", "component")
