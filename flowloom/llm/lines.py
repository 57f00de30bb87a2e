"""Dropping lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import SPACES, lower_az, whole_row
from flowloom.plans.lineage import written


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(SPACES)))


def line_dedup(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc, found): each row of ``docs`` as a struct, its text freed of common lines; found.n_lines, found.n_dropped.

    A text is split at newlines (null or empty: one empty line). A line's key is the line
    stripped of ASCII white space and lower-cased A-Z. Keys of at least ``least_chars``
    characters found in at least ``least_docs`` rows lose all their lines; the others stay
    as they were, joined by newlines. Keys are compared by 128 bits of hash. Only hashes
    and positions are exploded; each document's keys are made distinct before, and counts
    are combined before the shuffle, so a line that all have costs a row for each task.
    A null text stays null. Each row is a document of its own, but rows that agree in
    doc_id and text share their decision; null ids are matched like others. Columns of any
    name pass through inside ``doc``; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    keys = F.transform("lines", line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("i"))))
    hashed = written(lines.select("id", "mark", hashed.alias("hashes")))
    once = hashed.select(F.explode(F.array_distinct("hashes")).alias("k")).filter("k is not null")
    common = written(once.groupBy("k.h", "k.i").count().filter(F.col("count") >= least_docs).select("h", "i"))
    at = hashed.distinct().select("id", "mark", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "k"))
    at = at.select("id", "mark", "n", "pos", F.col("k.h").alias("h"), F.col("k.i").alias("i")).join(common, ["h", "i"], "left_semi")
    gone = at.groupBy("id", "mark", "n").agg(F.collect_list("pos").alias("gone"))
    kept = gone.select(F.col("id").alias("its_id"), F.col("mark").alias("its_mark"), F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone").alias("kept"))
    # the text goes along as its lines alone
    rest = whole_row(docs, text=F.lit(None).cast("string"))
    split = docs.select(rest.alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n", -1).alias("lines"))
    both = split.join(kept, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")), "left")
    left = F.when(F.col("kept").isNull(), F.col("lines")).otherwise(F.transform("kept", lambda i: F.col("lines")[i]))
    n = F.greatest(F.size("lines"), F.lit(1)).cast("long")
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long")
    found = F.struct(n.alias("n_lines"), dropped.alias("n_dropped"))
    return both.select(F.col("doc").withField("text", F.array_join(left, "\n")).alias("doc"), found.alias("found"))


def without_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs``, whatever its columns, with ``text`` freed of common lines as ``line_dedup`` tells."""
    return line_dedup(docs, least_docs, least_chars).select("doc.*")
