"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.text import WORD, numbered_rows
from flowloom.plans.lineage import written
from flowloom.plans.ranking import numbered

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, 7


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1), of a run."""
    return round(random.Random(seed).random(), 6)


def size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with each source's target: ``share`` of all sizes by weight, at most ``most`` times its size.

    Sharing the excess again and again ends at target = min(most * size, level * weight)
    with one level for all; the sources that stop are those of the least size by weight,
    so running sums in that order give the level. Sources are ranked by ranges, so that
    they may be as many as hosts are.
    """
    ranked = numbered(sizes.select("source", "source_size"), F.col("source").asc_nulls_last(), name="at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = written(numbered(s, "ratio", F.col("source").asc_nulls_last(), name="fill", before={"full": "cap", "full_weight": "weight"}))
    all_size, all_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level if only the sources before this one stop; it holds from the first source that it does not fill
    s = s.withColumn("level", (F.lit(share) * F.lit(all_size or 0).cast("long") - F.col("full")) / (F.lit(all_weight or 1.0) - F.col("full_weight")))
    first = s.filter("level <= ratio").agg(F.min(F.struct("fill", "level")).alias("first")).first()["first"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["level"]) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def counted(light: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """``light`` (doc_id, source, size and more) with source_size, target and copies, as ``mixed`` tells."""
    bits = F.bin("size")
    hexes = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = written(light).withColumns({
        "class": F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)),
        "block": F.concat(F.substring(hexes, 1, 1), F.translate(F.substring(hexes, 2, 1), "0123456789abcdef", "0000111122223333")),
    })
    blocks = written(rows.groupBy("source", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumnRenamed("source", "name")
    running = W.partitionBy("source").orderBy("class", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    starts = starts.join(goal, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("s"), F.col("class").alias("c"), F.col("block").alias("b"), "before", "source_size", "target"
    )
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "class", "block").orderBy(F.col("doc_id").asc_nulls_last(), "size")))
    both = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("block") == F.col("b")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(k * rate + F.lit(offset(seed)))
    copies = (upto(F.col("before") + F.col("rank")) - upto(F.col("before") + F.col("rank") - 1)).cast("long")
    return both.select(*light.columns, "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies.

    A document's expected copies are target / source_size of its source. Their prefix sum
    within the source, plus one random offset, gives a copy at each integer it crosses:
    so copies differ from the expected number by less than one, and none has more than
    ``most``. Documents run in the order of size class (four leading bits), 64 blocks by
    md5 of the id, id and size; neighbours are thus of like size, and a source's taken
    words come near its target. The prefix sum is the block's, from counts by block, plus
    the rank within the block, so that a source of any number of rows is spread over
    tasks. Null or blank texts have size 0; a null source is a source, the last one; null
    ids come last in the first block of their class; repeated rows are taken like others;
    other columns are ignored; an empty table gives an empty result.
    """
    light = docs.select("doc_id", "source", size(F.col("text").cast("string")).alias("size"))
    return counted(light, weights, share, most, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc, found): the mix itself, each row of ``docs`` as a struct once for each time it is taken.

    found holds size, source_size, target and copy, 1 for the first. Rows are told apart
    by a number of their own, so null and repeated ids and columns of any name do no harm.
    """
    rows = numbered_rows(docs)
    light = rows.select("doc.doc_id", "doc.source", size(F.col("doc.text").cast("string")).alias("size"), "row")
    taken = counted(light, weights, share, most, seed).filter("copies > 0")
    taken = taken.select("row", F.struct("size", "source_size", "target").alias("found"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.join(taken, "row").select("doc", F.col("found").withField("copy", F.col("copy")).alias("found"))
