"""Nested spans: the innermost one around a position, and all around it, by sorted sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.joins import shuffled
from flowloom.plans.lineage import written


def innermost(points: DataFrame, spans: DataFrame, *keys: str, before: bool = False, count: str | None = None) -> DataFrame:
    """``points`` (keys, at, more) with ``span`` (start, end, more): the innermost of ``spans`` (keys, start, end, more) that holds ``at``, or null.

    Spans of one key are nested or apart; they hold their start but not their end, and
    empty ones hold nothing. Of equal spans one is inside the other, in no fixed order.
    Starts, ends and positions of a key are swept in order: the running number of open
    spans is the depth of a position, and the last span that was opened at this depth is
    still open, so it is the innermost. Time follows the number of rows, not nesting or
    pairs. A key's rows are one window, so keys should be bounded, as a source file is.
    Rows whose keys are null are among themselves. With ``before``, spans that start at a
    position don't hold it yet, so a span's own start asks for the span around it.
    ``count`` names a column for the number of spans that hold the position.
    """
    held = F.struct(*[c for c in spans.columns if c not in keys])
    asked = F.struct(*points.columns)
    none = lambda like, of: F.lit(None).cast(like.select(of.alias("x")).schema[0].dataType)
    event = lambda rows, at, order, tie, step, span, point: rows.select(*keys, at.alias("at"), F.lit(order).alias("order"), tie.alias("tie"), F.lit(step).alias("step"), span.alias("span"), point.alias("point"))
    real = spans.filter(F.col("start") < F.col("end"))
    no_span, no_point = none(spans, held), none(points, asked)
    events = event(real, F.col("start"), 2, -F.col("end"), 1, held, no_point)
    events = events.union(event(real, F.col("end"), 0, F.lit(0).cast("long"), -1, no_span, no_point))
    events = events.union(event(points, F.col("at"), 1 if before else 3, F.lit(0).cast("long"), 0, no_span, asked))
    swept = lambda *by: W.partitionBy(*by).orderBy("at", "order", "tie").rowsBetween(W.unboundedPreceding, 0)
    deep = events.withColumn("depth", F.sum("step").over(swept(*keys)))
    # a start counts itself, so spans and the positions in them have one depth; at depth 0 nothing is open
    found = deep.withColumn("span", F.last("span", ignorenulls=True).over(swept(*keys, "depth")))
    around = [F.col("depth").alias(count)] if count else []
    return found.filter("point is not null").select("point.*", F.when(F.col("depth") > 0, F.col("span")).alias("span"), *around)


def enclosing(points: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """A row of ``points`` for each of ``spans`` (keys, start, end, more) around its ``at``, with ``span`` and ``out``, 0 for the innermost.

    One join for each level of nesting, on the span's key and start. Spans of a key differ in their start.
    """
    parents = innermost(spans.withColumn("at", F.col("start")), spans, *keys, before=True).select(*keys, F.col("start").alias("__start"), F.col("span").alias("__outer")).filter("__outer is not null")
    parents = written(parents)
    level = written(innermost(points, spans, *keys).filter("span is not null").withColumn("out", F.lit(0)))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        outer = level.withColumn("__start", F.col("span.start")).join(shuffled(parents), [*keys, "__start"])
        level = written(outer.select(*[F.col("__outer").alias(c) if c == "span" else (F.col(c) + 1).alias(c) if c == "out" else c for c in level.columns]))
    return reduce(DataFrame.union, levels) if levels else level


def reaching(uses: DataFrame, settings: DataFrame, *keys: str) -> DataFrame:
    """``uses`` (keys, at, more) with ``value``: what the last of ``settings`` (keys, at, start, end, value) before a use gave the name, or null.

    An as-of join by a sweep. A setting holds for sure only for uses in its own block
    ``start`` to ``end``; a use outside of it, or after a setting without a known value,
    gets null, as one before all settings does. At one position settings come first.
    """
    setting = F.struct("start", "end", "value")
    asked = F.struct(*uses.columns)
    events = settings.select(*keys, "at", F.lit(0).alias("order"), setting.alias("setting"), F.lit(None).cast(uses.select(asked).schema[0].dataType).alias("use"))
    events = events.union(uses.select(*keys, "at", F.lit(1), F.lit(None).cast(settings.select(setting).schema[0].dataType), asked))
    last = F.last("setting", ignorenulls=True).over(W.partitionBy(*keys).orderBy("at", "order").rowsBetween(W.unboundedPreceding, 0))
    found = events.withColumn("setting", last).filter("use is not null")
    inside = (F.col("setting.start") <= F.col("use.at")) & (F.col("use.at") < F.col("setting.end"))
    return found.select("use.*", F.when(inside, F.col("setting.value")).alias("value"))
