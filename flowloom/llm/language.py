"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.text import id_bucket, numbered_rows, whole_row
from flowloom.plans.lineage import written

#: Ranks in a profile; the out-of-place distance of an n-gram that a profile lacks.
RANKS = 300
#: A language's profile is fitted on about so many documents at most, chosen by a hash of their ids.
FITTED = 4000
#: Up to so many profiles travel to the tasks; more stay in a table, to which the documents' n-grams are joined.
LANGUAGES = 1000

Profiles = dict[str, np.ndarray] | DataFrame


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the text's words, a border at each end of a word; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    c = np.concatenate(([0], np.where(letters[c.astype(np.int64)], c, 0), [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c += np.uint64(1)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = (two[:-1] << np.uint64(21) | c[2:])[c[1:-1] > 1]
    return np.unique(np.concatenate((c[c > 1], two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes; of equal counts the smaller code first."""
    return codes[np.argsort(-counts, kind="stable")[:n]]


def fitted_profiles(labelled: DataFrame, ranks: int = RANKS, most: int = FITTED, languages: int = LANGUAGES) -> Profiles:
    """lang to its ``ranks`` most frequent n-grams, from the rows of ``labelled`` (doc_id, text, lang) with a lang.

    All values of lang are learned. More than ``languages`` of them stay a table (lang, gram, rank).
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("rows")) * 1_000_003
    sizes = written(labelled.groupBy("lang").agg(F.count("*").alias("rows")))
    # a few languages travel to the texts; for many, both sides are shuffled and hot languages split
    sizes = F.broadcast(sizes) if sizes.limit(languages + 1).count() <= languages else sizes
    sample = labelled.join(sizes, "lang").filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_003)) < share)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                parts = [grams(t, letters) for t in group["text"]]
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": n})

    counts = sample.select("text", "lang").mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= ranks)
    top = written(top.select("lang", "gram", "rank"))
    if top.select("lang").distinct().limit(languages + 1).count() > languages:
        return top
    found: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(codes, np.uint64) for lang, codes in found.items()}


def _joined(docs: DataFrame, profiles: DataFrame, ranks: int) -> DataFrame:
    """``predicted`` for profiles that stay a table: out-of-place distances by a join on the n-gram.

    A language that shares no n-gram with a document has the largest distance; of these the first stands for all.
    """

    @F.pandas_udf("array<long>")
    def tops(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters = letter_table()
        for texts in batches:
            yield pd.Series([ranked(*grams(t, letters), ranks).view(np.int64) for t in texts])

    rows = numbered_rows(docs)
    listed = written(rows.select("row", tops(F.col("doc.text").cast("string")).alias("top")))
    each = listed.select("row", F.size("top").alias("n"), F.posexplode("top").alias("place", "gram"))
    near = each.join(profiles, "gram").groupBy("row", "n", "lang").agg(F.sum(ranks - F.abs(F.col("place") - F.col("rank") + 1)).alias("gain"))
    whole = F.col("n") * ranks
    away = near.select("row", "n", F.struct((whole - F.col("gain")).alias("away"), "lang").alias("found"))
    first = profiles.agg(F.min("lang").alias("lang"))
    away = away.union(listed.filter(F.size("top") > 0).join(first).select("row", F.size("top"), F.struct((F.size("top") * ranks).cast("long"), "lang")))
    least = away.groupBy("row", "n").agg(F.min("found").alias("found")).select("row", "found.lang", (1 - F.col("found.away") / whole).alias("score"))
    found = F.struct(F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.join(least, "row", "left").select("doc", found.alias("found"))


def predicted(docs: DataFrame, profiles: Profiles, ranks: int = RANKS) -> DataFrame:
    """(doc, found): each row of ``docs`` as a struct, and a struct of lang_pred and score, from whole texts alone.

    The distance of a document to a language sums, over the document's ``ranks`` most
    frequent n-grams, how far out of place each is in the profile (``ranks`` if absent).
    The least distance wins, of equal ones the first language by code point. score is one
    less the distance as a part of the largest possible. Null texts, texts without a
    letter, and all texts when nothing was learned, give ``und`` and 0.
    """
    if isinstance(profiles, DataFrame):
        return _joined(docs, profiles, ranks)
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.uint64)
    places = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        places[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            best, score = [], []
            for text in texts:
                top = ranked(*grams(text, letters), ranks)
                if not len(top) or not len(known):
                    best.append("und")
                    score.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                place = places[:, np.where(known[at] == top, at, len(known))]
                away = np.where(place < 0, ranks, np.abs(place - np.arange(len(top)))).sum(axis=1)
                best.append(langs[int(away.argmin())])
                score.append(1 - float(away.min()) / (ranks * len(top)))
            yield pd.DataFrame({"lang_pred": best, "score": score})

    return docs.select(whole_row(docs).alias("doc"), of(F.col("text").cast("string")).alias("found"))


def identified(docs: DataFrame, ranks: int = RANKS, most: int = FITTED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out.

    Rows whose crc32 of the id modulo 3 is 1 are held out. Repeated rows, null ids (held
    out or not as empty text is) and extra columns do no harm; an empty table gives an
    empty result; ties are settled as ``predicted`` says.
    """
    profiles = fitted_profiles(docs.filter(id_bucket(F.col("doc_id"), 3) != 1), ranks, most)
    found = predicted(docs.select("doc_id", "text"), profiles, ranks)
    return found.select("doc.doc_id", (id_bucket(F.col("doc.doc_id"), 3) == 1).alias("held_out"), "found.lang_pred", "found.score")
