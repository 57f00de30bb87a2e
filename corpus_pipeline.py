"""A corpus pipeline of five operators, each stage over all that the one before kept.

Every stage reads and, but for the last, returns the columns of documents; other columns,
whatever their names, are left behind. Stages decide by row: where a decision has to
find its row again, rows get a number of their own in a table, so null, repeated and
shared ids are no special cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, language, lines, mixing, resemble, simhash
from flowloom.llm.components import components
from flowloom.llm.text import id_bucket, numbered_rows
from flowloom.plans.lineage import settled, written
from flowloom.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go.

    These are null texts and texts without a letter (empty ones too), or all if no row
    names a language. Very long texts are read whole; repeated rows are told alike; of
    languages at equal distance the first by code point is told, which keeps the row
    either way. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    profiles = language.fitted_profiles(docs.filter(id_bucket(F.col("doc_id"), 3) != 1))
    return language.predicted(docs, profiles).filter("found.lang_pred <> 'und'").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from the texts; n_chars follows.

    All rows stay, in some cases with an empty text. A null text stays null, with null
    n_chars; a line counts once for each row, repeated rows included, and very long texts
    are split whole. An empty table gives an empty one.
    """
    kept = lines.without_common_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_groups(texts: DataFrame) -> DataFrame:
    """(row, component) of ``texts`` (row, text): the groups of op1's fingerprints, SimHash within 3 bits, joined with those of exact resemblance.

    That radius reaches few near copies that are not identical, so resemblance adds what it
    leaves apart. Either kind of group is named by a row of its own, so a row's two names are a link.
    """
    prints = simhash.near_duplicates(texts.withColumnRenamed("row", "doc_id")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("near"))
    both = written(resemble.resemblance_groups(texts).join(prints, "row"))
    roots = components(both.filter("component <> near").select(F.col("component").alias("a"), F.col("near").alias("b")).distinct())
    return both.join(roots.toDF("component", "root"), "component", "left").select("row", F.coalesce("root", "component").alias("component"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates exactly one row stays: of the least id, null ids last; of equal ids the least row number.

    Near-duplicates are rows that links of SimHash fingerprints within 3 bits or of a shingle
    similarity of 0.8 connect. Null and blank texts are one group. Very long texts are compared whole. Of repeated
    rows one stays. An empty table gives an empty one.
    """
    rows = numbered_rows(docs.select(*COLUMNS))
    placed = settled(spark, lambda: rows.select("row", "doc.doc_id").join(near_groups(rows.select("row", "doc.text")), "row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = placed.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    gone = placed.join(best, "component").filter("row <> best.row").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their id; other rows of the same id stay.

    Null and blank texts hold nothing and stay; very long texts are searched whole;
    repeated rows go or stay together. An empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row once for each time it is taken, with size, source_size, target and copy; rows that are not taken go.

    A null source is a source; null and blank texts have size 0 and are taken at their
    source's rate; repeated rows are taken each for itself; a very long text counts whole.
    An empty table gives an empty one.
    """
    return mixing.mixture(docs.select(*COLUMNS)).select("doc.*", "found.*")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: SQL cannot express language profiles, near-duplicate components or the similarity of windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
