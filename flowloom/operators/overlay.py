"""Runtime events over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.plans.lineage import written

# Diagnostics of events, and why an item counts as observed.
CODES = {"ambiguous": "runtime_event_ambiguous", "unmatched": "runtime_event_unmatched", "conflict": "runtime_identity_conflict"}
ENDPOINT, VIEW, RESOLUTION = "runtime_coherent_endpoint", "runtime_coherent_view", "runtime_coherent_resolution"


def match(events: DataFrame, urls: DataFrame, views: DataFrame, links: DataFrame, calls: DataFrame) -> DataFrame:
    """Outcome of each event (event_id, endpoint_id, view_name): observed, ambiguous, unmatched or conflict.

    ``urls`` (url, endpoint_id), ``views`` (view, view_name), ``links`` (url, view) from
    urls to views, ``calls`` (url, edge) into urls. The outcome depends on the endpoint
    and the view name alone, so it is decided once for each distinct pair. Links count
    only between one URL and one view that were asked for, so others are never counted,
    and where links come from a join, Spark drops the others before that join.
    """
    pairs = events.select("endpoint_id", "view_name").distinct()
    u = urls.groupBy("endpoint_id").agg(F.count("*").alias("n_u"), F.min("url").alias("url"))
    v = views.groupBy("view_name").agg(F.count("*").alias("n_v"), F.min("view").alias("view"))
    i = calls.groupBy("url").agg(F.count("*").alias("n_i"), F.min("edge").alias("edge"))
    known = pairs.join(u, "endpoint_id", "left").join(v, "view_name", "left")
    uv = _between(links, known.filter("n_u = 1 and n_v = 1")).groupBy("url", "view").agg(F.count("*").alias("n_uv"))
    s = known.join(uv, ["url", "view"], "left").join(i, "url", "left").fillna(0, ["n_u", "n_v", "n_uv", "n_i"])
    named = F.col("view_name").isNotNull()
    off = (F.col("n_u") != 1) | (named & (F.col("n_v") != 1))
    outcome = (
        F.when(off & ((F.col("n_u") > 1) | (named & (F.col("n_v") > 1))), "ambiguous").when(off, "unmatched")
        .when(named & (F.col("n_uv") != 1), "conflict").when(F.col("n_i") > 1, "ambiguous").when(F.col("n_i") == 0, "unmatched").otherwise("observed")
    )
    decided = s.select(F.col("endpoint_id").alias("__e"), F.col("view_name").alias("__v"), "url", "view", "edge", outcome.alias("outcome"))
    return events.join(decided, events["endpoint_id"].eqNullSafe(F.col("__e")) & events["view_name"].eqNullSafe(F.col("__v")), "left").drop("__e", "__v")


def _between(links: DataFrame, asked: DataFrame) -> DataFrame:
    """``links`` whose URL and whose view are among those ``asked``; one column at a time, which goes below a join that makes the links."""
    for end in ("url", "view"):
        links = links.join(asked.select(end).distinct(), end, "left_semi")
    return links


def capped(evidence: DataFrame, key: str, *order: str, most: int = 32) -> DataFrame:
    """The first ``most`` distinct rows of each key in ``order``, ranked before anything is collected.

    A key is ranked in 64 salted parts first, which pass on ``most`` rows each, so a hot key
    is never ranked by one task alone.
    """
    whole = W.partitionBy(key).orderBy(*order)
    salted = evidence.distinct().withColumn("__s", F.pmod(F.xxhash64(*order), F.lit(64)))
    first = salted.withColumn("__r", F.row_number().over(W.partitionBy(key, "__s").orderBy(*order))).filter(F.col("__r") <= most)
    return first.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= most).drop("__s", "__r")


def lifted(confidence: Column, observed: Column) -> Column:
    """At least 0.95 once observed."""
    return F.when(observed, F.greatest(confidence, F.lit(0.95))).otherwise(confidence)


def written_back(observed: DataFrame, links: DataFrame, items: DataFrame, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """(evidence, items): what matched events leave on their URL, view, edge between these and calling edge.

    ``observed`` are the rows of ``match`` that are observed, with timestamp; ``links``
    (url, view, link); ``items`` (id, n_evidence, confidence). New evidence (id, reason,
    event_id, timestamp) is distinct, in the order of these columns, and fills an item up
    to ``most`` with what it has; items that gain some have a confidence of at least 0.95.
    """
    named = F.col("view_name").isNotNull()
    linked = observed.join(_between(links, observed).select("url", "view", "link"), ["url", "view"], "left")
    hit = lambda column, reason: F.struct(F.col(column).cast("string").alias("id"), F.lit(reason).alias("reason"))
    hits = F.array(hit("url", ENDPOINT), F.when(named, hit("view", VIEW)), F.when(named, hit("link", VIEW)), hit("edge", RESOLUTION))
    all_ = linked.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"), "event_id", "timestamp").select("h.*", "event_id", "timestamp")
    # as a table its size is known: where it is small, no item is shuffled
    first = written(capped(all_, "id", "reason", "event_id", "timestamp", most=most))
    rank = F.row_number().over(W.partitionBy("id").orderBy("reason", "event_id", "timestamp"))
    evidence = first.withColumn("rank", rank).join(items.select("id", "n_evidence"), "id").filter(F.col("rank") + F.col("n_evidence") <= most).drop("rank", "n_evidence")
    # ranks have no gaps, so what fits is a number, and items are gone through once
    fresh = written(first.groupBy("id").agg(F.count("*").alias("fresh")))
    room = most - F.col("n_evidence")
    gained = F.when(room > 0, F.least(F.col("fresh"), room)).otherwise(0)
    after = items.join(fresh, "id", "left").fillna(0, ["fresh"]).withColumn("gained", gained)
    return evidence, after.select("id", (F.col("n_evidence") + F.col("gained")).alias("n_evidence"), lifted(F.col("confidence"), F.col("gained") > 0).alias("confidence"))


def event_diagnostics(matched: DataFrame, urls: DataFrame, views: DataFrame, calls: DataFrame) -> DataFrame:
    """(event_id, code, candidates) of the events that are not observed; ``calls`` here with their ``source``.

    Candidates are told of ambiguous events and conflicts: the URLs and views, or, where
    these are one each, the sources of the edges into the URL. They are gathered once for
    each endpoint and view name.
    """
    bad = matched.filter("outcome <> 'observed'")
    ids = lambda df, key, c: df.groupBy(key).agg(F.array_sort(F.collect_list(F.col(c).cast("string"))).alias(f"{c}s"))
    pairs = bad.select("endpoint_id", "view_name", "url", "outcome").distinct()
    known = pairs.join(ids(urls, "endpoint_id", "url"), "endpoint_id", "left").join(ids(views, "view_name", "view"), "view_name", "left").join(ids(calls, "url", "source"), "url", "left")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("urls", none), F.coalesce("views", none))
    one_each = (F.size(F.coalesce("urls", none)) == 1) & (F.col("view_name").isNull() | (F.size(F.coalesce("views", none)) == 1))
    candidates = F.when(F.col("outcome") == "conflict", both).when(F.col("outcome") == "ambiguous", F.when(one_each, F.coalesce("sources", none)).otherwise(both))
    told = known.select(F.col("endpoint_id").alias("e"), F.col("view_name").alias("v"), candidates.alias("candidates"))
    code = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("outcome"))
    return bad.join(told, bad["endpoint_id"].eqNullSafe(F.col("e")) & bad["view_name"].eqNullSafe(F.col("v"))).select("event_id", code.alias("code"), "candidates")
