"""Approximate nearest neighbours by inner product: shifted Hilbert curves over projected vectors, windows of keys, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.vectors import first_of_each, stacked, usable
from flowloom.plans.lineage import written
from flowloom.plans.ranking import numbered

NEAREST = 20
#: Orderings, and projected axes and bits of an axis in each.
CURVES, AXES, BITS = 8, 6, 10
#: Queries on which the width of the windows is fitted, and the share of their true neighbours that some window must hold.
FITTED, RECALL = 128, 0.96
#: Rows of a block that a task searches, at least and at most.
BLOCK = 1024, 16_384
SEED = 11
NULL = np.iinfo(np.int64).max


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of the rows of ``cells``, whole numbers below 2**bits on each axis."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrorings of each level, the coarsest first
        low = (1 << b) - 1
        for i in range(len(x)):
            set_ = (x[i] >> b & 1).astype(bool)
            swapped = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swapped)
            x[i] = x[i] ^ swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis ^ turned) >> b & 1
    return key


def curve_keys(unit: np.ndarray, curve: int, seed: int = SEED) -> np.ndarray:
    """Keys on one of the curves for vectors of length 1: a projection and a shift of the curve's own."""
    rnd = np.random.default_rng([seed, unit.shape[1], curve])
    axes = min(AXES, unit.shape[1])
    onto = np.linalg.qr(rnd.standard_normal((unit.shape[1], axes)))[0]
    at = (np.clip(unit @ onto, -1, 1) + 1 + rnd.uniform(0, 0.5, axes)) / 2.5
    return hilbert_keys(np.minimum(at * (1 << BITS), (1 << BITS) - 1), BITS)


def _keyed(curves: int):
    schema = pa.schema([("d", pa.int32()), ("curve", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("is_row", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch["d"].to_numpy()
            for size in np.unique(d):
                part = batch.filter(pa.array(d == size))
                x, rows, asks = stacked(part["v"]), part["row"].to_numpy(), part["asks"].to_numpy(zero_copy_only=False)
                norms, most = np.linalg.norm(x, axis=1), part["most"].to_numpy()
                # one more component brings all rows to one length, so that the nearest rows are those of largest inner product
                as_rows = np.hstack([x / most[:, None], np.sqrt(np.maximum(0, 1 - (norms / most) ** 2))[:, None]])
                as_queries = np.hstack([x / norms[:, None], np.zeros((len(x), 1))])[asks]
                for curve in range(curves):
                    for unit, of, is_row in ((as_rows, rows, 1), (as_queries, rows[asks], 0)):
                        if len(of):
                            n = len(of)
                            columns = [np.full(n, size, np.int32), np.full(n, curve, np.int32), curve_keys(unit, curve), of, np.full(n, is_row, np.int64)]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return keyed


def _nearest(x: np.ndarray, q: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score): the ``most`` rows of largest inner product with each query among the ``allowed`` (queries by rows)."""
    quick = np.where(allowed, q @ x.T, -np.inf)
    kth = np.partition(quick, -most, axis=1)[:, -most] if len(x) > most else np.full(len(q), -np.inf)
    # a matrix product may round equal rows differently, so all within its error are summed again, row by row
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    i, j = np.nonzero(allowed & (quick >= (kth - slack)[:, None]))
    score = (q[i] * x[j]).sum(axis=1)
    best = first_of_each(i, score, ids[j], rows[j], most)
    return i[best], j[best], score[best]


def _true_neighbours(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, row): the exact nearest of ``queries``, a bounded number, among all rows."""
    found = queries.select("row", "d", "v").collect()  # FITTED at most
    asked = {d: (np.array([r["row"] for r in found if r["d"] == d]), np.array([r["v"] for r in found if r["d"] == d], float)) for d in {r["d"] for r in found}}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch["d"].to_numpy()
            for size in set(d.tolist()) & set(asked):
                part = batch.filter(pa.array(d == size))
                of, q = asked[size]
                rows = part["row"].to_numpy()
                ids = part["vec_id"].fill_null(NULL).to_numpy()
                i, j, score = _nearest(stacked(part["v"]), q, of[:, None] != rows[None, :], ids, rows, most)
                yield pa.RecordBatch.from_arrays([pa.array(of[i]), pa.array(rows[j]), pa.array(ids[j]), pa.array(score)], names=["query", "row", "vec_id", "score"])

    near = vectors.select("d", "row", "vec_id", "v").mapInArrow(scanned, "query long, row long, vec_id long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).select("query", "row")


def fitted_window(vectors: DataFrame, places: DataFrame, most: int, share: float = RECALL, fitted: int = FITTED) -> int:
    """The least distance along the curves within which ``share`` of the true neighbours of ``fitted`` queries lie on some curve."""
    queries = vectors.filter("asks").orderBy(F.xxhash64("row"), "row").limit(fitted)
    near = written(_true_neighbours(vectors, queries, most))
    asked = near.join(places.filter("is_row = 0").select(F.col("row").alias("query"), "curve", F.col("at").alias("from")), "query")
    apart = asked.join(places.filter("is_row = 1").select("row", "curve", "at"), ["row", "curve"])
    apart = apart.groupBy("query", "row").agg(F.min(F.abs(F.col("at") - F.col("from"))).alias("apart")).collect()  # fitted * most rows
    return max(most, int(np.quantile([r["apart"] for r in apart], share, method="higher")) + 1) if apart else most


def nearest_neighbours(vectors: DataFrame, every: int, most: int = NEAREST, curves: int = CURVES, share: float = RECALL, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``most`` nearest other rows found.

    Nearness is the largest inner product, in doubles, on the vectors as given; ties go by
    vec_id. One further component turns it into nearness between vectors of one length;
    each of ``curves`` projections and shifts orders all rows along a Hilbert curve, by
    ranges of keys. A query looks through a window on either side of its key on every
    curve; the windows' best are merged. How wide the windows are is fitted on 128
    queries, which are compared with all rows: so wide that some window holds ``share`` of
    their true neighbours. Windows are searched in blocks of rows in their order, whatever
    keys or copies crowd together; blocks are about as large as a window, within bounds.

    Rows with a null or empty vector, one of zeros, or a null or non-finite component take
    no part. Vectors are compared with those of their own length only. A null vec_id is no
    query and comes last among ties; a repeated row is a neighbour, and a query, for
    each time. Other columns are ignored. An empty table gives an empty result.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(usable(v) & F.exists(v, lambda x: x != 0))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "d": F.size("v"), "asks": F.coalesce(F.col("vec_id") % every == 0, F.lit(False))})
    rows = written(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))))
    most_norm = rows.groupBy("d").agg(F.max("norm").alias("most"))
    keys = rows.join(most_norm, "d").select("d", "row", "asks", "most", "v").mapInArrow(_keyed(curves), "d int, curve int, key long, row long, is_row long")
    # a hash deals rows of one key anew on each curve
    placed = numbered(keys.withColumn("mix", F.xxhash64("row", "curve")), "d", "curve", "key", "mix", "row", "is_row", before={"at": "is_row"})
    places = written(placed.select("d", "curve", "row", "is_row", "at"))
    width = fitted_window(rows, places, most, share)
    size = min(max(width, block[0]), block[1])

    gathered = places.groupBy("row", "is_row").agg(F.collect_list(F.struct("curve", "at")).alias("on"))  # one for each curve
    data = rows.select("row", "d", "vec_id", "v")
    spread = lambda is_row: gathered.filter(F.col("is_row") == is_row).join(data, "row").select("row", "d", "vec_id", "v", F.inline("on"))
    held = spread(1).withColumn("block", F.floor(F.col("at") / size))
    blocks = F.sequence(F.floor((F.col("at") - width) / size), F.floor((F.col("at") + width - 1) / size))
    asking = spread(0).withColumn("block", F.explode(blocks)).toDF("row", "d", "vec_id", "v", "curve", "at", "block")  # renamed: both sides of a cogroup come from one table
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(queries: pa.Table, among: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(among):
            x, at, row = stacked(among["v"]), among["at"].to_numpy(), among["row"].to_numpy()
            ids = among["vec_id"].fill_null(NULL).to_numpy()
            for start in range(0, len(queries), 256):
                part = queries.slice(start, 256)
                of, centre, name = part["row"].to_numpy(), part["at"].to_numpy()[:, None], part["vec_id"].to_numpy()
                i, j, score = _nearest(x, stacked(part["v"]), (centre - width <= at) & (at < centre + width) & (of[:, None] != row), ids, row, most)
                found.append(pa.table([of[i], name[i], row[j], pa.array(ids[j], mask=ids[j] == NULL), score], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    near = asking.groupBy("d", "curve", "block").cogroup(held.groupBy("d", "curve", "block")).applyInArrow(searched, "query long, query_id long, row long, vec_id long, score double")
    near = near.groupBy("query", "row").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
