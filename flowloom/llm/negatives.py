"""Hard negatives by a pivot table: stored distances to pivots bracket inner products, exact checks decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.vectors import first_of_each, stacked, usable
from flowloom.plans.lineage import written
from flowloom.plans.ranking import numbered

#: Positives of an anchor, negatives of a positive, and percent of the positive's score that a negative's must reach and must not pass.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Pivots, and rows that they are picked from.
PIVOTS, SAMPLE = 16, 1024
#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 512
NULL = np.iinfo(np.int64).max
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Relative room for rounding in a bracket.
SLACK = 1e-9


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``a``, whole numbers; those beyond a long come out as its end."""
    size = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(a.astype(float)).max(initial=0)) * len(a)
    if size < 2**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    if size < 2**62:
        return x @ a
    return np.clip(x.astype(object) @ a.astype(object), LOW, HIGH).astype(np.int64)


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``x`` picked one by one, each the farthest from those before."""
    picked = x[:1]
    away = np.linalg.norm(x - picked[0], axis=1)
    while len(picked) < most and away.max(initial=0) > 0:
        picked = np.vstack([picked, x[away.argmax()]])
        away = np.minimum(away, np.linalg.norm(x - picked[-1], axis=1))
    return picked


def _augmented(v: np.ndarray, most: np.ndarray) -> np.ndarray:
    """One more component brings rows to the length ``most``; inner products with anchors, whose further component is 0, stay."""
    return np.hstack([v, np.sqrt(np.maximum(0, most**2 - (v**2).sum(axis=1)))[:, None]])


def _pivoted(pivots: dict[int, np.ndarray]):
    names = ["row", "d", "vec_id", "label", "asks", "most", "v", "away", "asked", "cell", "near"]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch["d"].to_numpy()
            for size in np.unique(d):
                part = batch.filter(pa.array(d == size))
                v = stacked(part["v"])
                held = pivots.get(int(size), np.zeros((1, size + 1)))
                of = lambda x, p=held: np.stack([np.linalg.norm(x - one, axis=1) for one in p], axis=1)
                away, asked = of(_augmented(v, part["most"].to_numpy())), of(np.hstack([v, np.zeros((len(v), 1))]))
                lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (away, asked)]
                columns = [part[c] for c in names[:7]] + [*lists, pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(away.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored


def _checked(same: bool, keep: int, blocks: str):
    """Searches a block of rows for a block of anchors; (anchor, tag, row, vec_id, score), the ``keep`` best in each of the anchor's bands."""
    schema = pa.schema([("anchor", pa.int64()), ("tag", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def checked(anchors: pa.Table, among: pa.Table) -> pa.Table:
        if not len(anchors) or not len(among):
            return schema.empty_table()
        x, away, row, labels = stacked(among["v"], np.int64), stacked(among["away"]), among["row"].to_numpy(), among["label"].to_numpy()
        ids, most = among["vec_id"].fill_null(NULL).to_numpy(), float(among["most"][0].as_py())
        out: list[tuple[np.ndarray, ...]] = []
        for one in anchors.select(["row", "label", "v", "asked", "bands"]).to_pylist():
            a, bands = np.array(one["v"], np.int64), one["bands"]
            apart = away - np.array(one["asked"])
            nearest, farthest = np.abs(apart).max(axis=1), (away + np.array(one["asked"])).min(axis=1)
            whole = float((a.astype(float) ** 2).sum()) + most**2
            room = SLACK * whole + 1
            could = ((whole - nearest**2) / 2 + room >= min(b["low"] for b in bands)) & ((whole - farthest**2) / 2 - room <= max(b["high"] for b in bands))
            could &= (row != one["row"]) & ((labels == one["label"]) == same)
            at = np.flatnonzero(could)
            if not len(at):
                continue
            score = products(x if len(at) == len(x) else x[at], a)
            for band in bands:
                fits = np.flatnonzero((score >= band["low"]) & (score <= band["high"]))
                best = fits[first_of_each(np.zeros(len(fits), int), score[fits], ids[at[fits]], row[at[fits]], keep)]
                tag = np.full(len(best), band["tag"])
                out.append((np.full(len(best), one["row"]), tag, row[at[best]], ids[at[best]], score[best]))
        if not out:
            return schema.empty_table()
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        columns[3] = pa.array(columns[3], mask=columns[3] == NULL)
        return pa.table(columns, schema=schema)

    of = "anchor long, tag long, row long, vec_id long, score long"
    renamed = lambda anchors: anchors.toDF(*anchors.columns)  # noqa: E731  both sides of a cogroup come from one table
    return lambda anchors, rows: renamed(anchors).groupBy("d", *blocks.split()).cogroup(rows.groupBy("d", *blocks.split())).applyInArrow(checked, of)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("anchor", "tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _searched(anchors: DataFrame, rows: DataFrame, same: bool, keep: int) -> DataFrame:
    """(anchor, tag, row, vec_id, score, rank) for anchors with ``bands``: the exact ``keep`` best rows in each.

    First each anchor looks through its own block of rows, where the nearest ones are
    likely; where a band finds ``keep`` rows there, the last one's score is the least that
    counts. Then blocks of anchors and of rows meet where the bracket of their pivot
    distances reaches the least score of one of the anchors.
    """
    home = _ranked(_checked(same, keep, "block")(anchors, rows), keep)
    kth = home.filter(F.col("rank") == keep).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("kth"))  # POSITIVES bands at most
    # a tag is never null, so the map's keys are the bands'
    better = F.transform("bands", lambda b: F.struct(b["tag"].alias("tag"), F.greatest(b["low"], F.coalesce(F.element_at("kth", b["tag"]), b["low"])).alias("low"), b["high"].alias("high")))
    anchors = written(anchors.join(kth.withColumnRenamed("anchor", "row"), "row", "left").withColumn("bands", better).drop("kth"))
    least = F.array_min(F.transform("bands", lambda b: b["low"]))
    each = range(PIVOTS)
    ends = lambda c: [f(F.get(F.col(c), j)).alias(f"{c}_{f.__name__}_{j}") for j in each for f in (F.min, F.max)]
    asking = anchors.groupBy("d", "group").agg(F.min(least).alias("least"), F.max("square").alias("square"), *ends("asked"))
    held = rows.groupBy("d", "block").agg(F.max("most").alias("most"), *ends("away"))
    gap = F.greatest(F.lit(0.0), *[F.coalesce(F.greatest(F.col(f"away_min_{j}") - F.col(f"asked_max_{j}"), F.col(f"asked_min_{j}") - F.col(f"away_max_{j}")), F.lit(0.0)) for j in each])
    whole = F.col("square") + F.col("most") * F.col("most")
    meeting = written(asking.join(held, "d").filter((whole - gap * gap) / 2 + SLACK * whole + 1 >= F.col("least")).select("d", "group", "block"))
    dealt = anchors.drop("block").join(meeting, ["d", "group"])
    return _ranked(_checked(same, keep, "group block")(dealt, rows.join(meeting, ["d", "block"])), keep)


def hard_negatives(
    vectors: DataFrame, every: int, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, rows_in_block: int = ROWS, anchors_in_block: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose vec_id is divisible by ``every``.

    Components become floor(256 * x). An anchor's positives are the ``positives`` other
    rows of its label with the highest inner products; of each, the first ``negatives``
    rows of other labels follow whose score is ``least`` to ``most`` percent of the
    positive's. Scores are exact whole numbers; equal ones go by vec_id, null ids last.

    One more component turns inner products into distances between rows of one length and
    anchors. Each row's distances to ``PIVOTS`` pivots, picked from a sample of rows, are
    stored; by the triangle inequality they bracket a pair's score, first for blocks of
    anchors and rows (in the order of the nearest pivot), then for an anchor and each row of
    a block, and rows whose bracket reaches the anchor's bands are checked exactly. A pair
    of blocks is one group of bounded size; no label or cell is gathered whole.

    Rows with a null label, a null or empty vector, or a null or non-finite component take
    no part. Vectors are compared with those of their own length. Components and scores
    beyond a long come out as its end. A null vec_id is no anchor; a repeated row counts for
    each time, as an anchor too. A band of a negative positive score is empty. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("label").isNotNull()).withColumn("v", F.transform("v", lambda x: F.floor(256 * x.cast("double"))))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "d": F.size("v"), "asks": F.coalesce(F.col("vec_id") % every == 0, F.lit(False))})
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = written(rows.withColumn("square", square))
    size = rows.groupBy("d").agg(F.sqrt(F.max("square")).alias("most"))
    sized = rows.join(size, "d")
    sample = sized.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("d", "most", "v").collect()
    pivots = {}
    for d in {r["d"] for r in sample}:
        of = [r for r in sample if r["d"] == d]
        pivots[d] = farthest_first(_augmented(np.array([r["v"] for r in of], float), np.array([r["most"] for r in of])), PIVOTS)
    stored = "row long, d int, vec_id long, label long, asks boolean, most double, v array<long>, away array<double>, asked array<double>, cell int, near double"
    placed = numbered(sized.select("row", "d", "vec_id", "label", "asks", "most", "v").mapInArrow(_pivoted(pivots), stored), "d", "cell", "near", "row", name="pos")
    placed = written(placed.withColumn("block", F.floor((F.col("pos") - 1) / rows_in_block)))
    table = placed.select("d", "block", "row", "vec_id", "label", "most", "v", "away")
    band = lambda tag, low, high: F.struct(tag.cast("long").alias("tag"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    anchors = numbered(placed.filter("asks").select("pos", "d", "block", "row", "vec_id", "label", "v", "asked"), "pos", name="nth")
    anchors = anchors.withColumns({"group": F.floor((F.col("nth") - 1) / anchors_in_block), "square": square})
    anchors = written(anchors.withColumn("bands", F.array(band(F.lit(0), F.lit(LOW), F.lit(HIGH)))).drop("pos", "nth"))

    found = _searched(anchors, table, True, positives)
    chosen = written(found.select("anchor", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # least * positive <= 100 * negative <= most * positive, in whole numbers that can't overflow
    scaled = F.col("positive_score").cast("decimal(25,0)")
    low, high = F.ceil(scaled * least / 100), F.floor(scaled * most / 100)
    bands = chosen.filter("positive_score >= 0").groupBy("anchor").agg(F.collect_list(band(F.col("tag"), low, high)).alias("bands"))  # ``positives`` at most
    asking = written(anchors.drop("bands").join(bands.withColumnRenamed("anchor", "row"), "row"))
    near = _searched(asking, table, False, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = near.join(chosen, ["anchor", "tag"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
