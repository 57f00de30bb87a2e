"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def stacked(column: pa.ListArray | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A matrix of the lists of ``column``, which have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores of each group, equal scores by id (the greatest long stands for null) and row, group by group."""
    order = np.lexsort((rows, ids, -score, group))
    sorted_ = group[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, int)
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[within < most]
