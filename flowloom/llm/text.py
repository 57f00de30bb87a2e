"""Text conventions that the operators of this subpackage share.

A word is a run of bytes other than the six ASCII white-space bytes, and lower-casing
touches A-Z only; ``bytes.split()`` and ``bytes.lower()`` do exactly that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.plans.lineage import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole_row(docs: DataFrame, **instead: Column) -> Column:
    """A row of ``docs`` as one struct, so that columns of any name pass by an operator's own; ``instead`` replaces some."""
    return F.struct(*[instead[c].alias(c) if c in instead else F.col(f"`{c.replace('`', '``')}`").alias(c) for c in docs.columns])


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(doc, row): each row of ``docs`` as a struct, and a number of its own that holds in every later pass, kept in a table."""
    return written(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")))
