"""Joins of two tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join to be dealt by key over the tasks and sorted there, however small its files are.

    Spark takes a stored table's files for its size in memory. Paths and names compress to a twentieth
    and less, and columns left out are thought to be as wide as others, so what it sends to the driver and
    from there to all executors would be hundreds of MB and grow with the input.
    """
    return side.hint("merge")
