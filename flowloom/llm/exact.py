"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import lower_az
from flowloom.plans.lineage import written

BLOCK = 8192


def hash_pair(part: Column, seed: int) -> Column:
    """128 bits to sort blocks by; they need not be free of collisions."""
    return F.struct(F.xxhash64(F.lit(2 * seed), part).alias("h"), F.xxhash64(F.lit(2 * seed + 1), part).alias("i"))


def _parts(data: Column, block: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(block))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def _sort_key(hashed: Callable[[Column, int], Column], seed: int, part: Column) -> Column:
    return F.struct(F.octet_length(part).alias("len"), hashed(part, seed).alias("k"))


def _name_blocks(blocks: DataFrame) -> DataFrame | None:
    """Names of (len, h, i) if equal triples always mean equal bytes, else None.

    Copies of a block meet by the triple, combined on the map side to the least and the
    greatest of their bytes: if these are the same, all are. The triples are sorted and
    numbered in that order.
    """
    ends = blocks.groupBy("len", "k").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    ends = ends.select("len", "k", (F.col("low") != F.col("high")).alias("clash")).sortWithinPartitions("len", "k")
    names = written(ends.withColumn("name", F.monotonically_increasing_id()))
    return None if names.filter("clash").limit(1).count() else names.select("len", "k", "name")


def _named(items: DataFrame, by: list[str]) -> DataFrame:
    """``items`` with an integer ``name`` in place of the columns ``by``; equal values and only those share one.

    The distinct values are sorted and numbered in that order, partition by partition,
    once, in a table. Copies collapse before the shuffle, and a hot value can be split
    in the join.
    """
    names = written(items.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()))
    return items.join(names, by).drop(*by)


def identities(rows: DataFrame, data: Column, block: int = BLOCK, hashed: Callable[[Column, int], Column] = hash_pair) -> tuple[DataFrame, DataFrame]:
    """(numbered, names): ``rows`` with a key instead of their bytes, and (key, n_blocks, name) of every row.

    Two rows share (n_blocks, name) exactly if their bytes are equal. The bytes are cut
    into blocks of ``block``; blocks are sorted by length and hash, equal neighbours are
    proved equal by their bytes, and each distinct block gets an integer name. Should two
    different blocks ever agree in length and hash, all are sorted again by another hash,
    so names are free of collisions whatever the hash. Pairs of adjacent names are then
    named again, level by level, until each row has one: as many levels as the longest row
    has doublings of a block.
    """
    for seed in count():
        key = partial(_sort_key, hashed, seed)
        numbered = written(rows.withColumns({"key": F.monotonically_increasing_id(), "blocks": F.transform(_parts(data, block), key)}).drop("data"))
        blocks = rows.select(F.explode(_parts(data, block)).alias("part")).select("part", key(F.col("part")).alias("b")).select("part", "b.len", "b.k")
        if (names := _name_blocks(blocks)) is not None:
            break
    level = numbered.select("key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "b")).select("key", "n_blocks", "pos", "b.len", "b.k")
    level = written(level.join(names, ["len", "k"]).select("key", "n_blocks", "pos", "name"))
    done, left = [], level.agg(F.max("n_blocks")).first()[0] or 1
    while left > 1:
        here = F.ceil(F.col("n_blocks") / F.lit(1 << len(done)))
        done.append(level.filter(here == 1).select("key", "n_blocks", "name"))
        side = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(-1))
        pairs = level.filter(here > 1).groupBy("key", "n_blocks", F.shiftright("pos", 1).alias("half")).agg(side(0).alias("one"), side(1).alias("two"))
        level, left = written(_named(pairs.withColumnRenamed("half", "pos"), ["one", "two"])), (left + 1) // 2
    out = level.select("key", "n_blocks", "name")
    for more in done:
        out = out.union(more)
    return numbered.drop("blocks"), out


def exact_duplicates(docs: DataFrame, block: int = BLOCK, hashed: Callable[[Column, int], Column] = hash_pair) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Every text
    is named block by block, and the names decide. Of a group the largest doc_id stays;
    rows that repeat that id count in group_size, and one of them stays. A null doc_id
    loses to any other. Other columns are ignored; an empty table gives an empty result.
    """
    data = lower_az(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), F.sha2(data, 256).alias("text_sha256"))
    numbered, names = identities(source, F.col("data"), block, hashed)
    rows = written(numbered.join(names, "key"))
    groups = rows.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "key")).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("key") == F.col("keep.key")).alias("kept"), "text_sha256"
    )
