"""Analyse fragments into a stored graph and read it back.

A snapshot is a folder of Parquet tables that no reader sees until a commit of the project
names it; an older snapshot stays whole until then, and a job that dies half-way leaves the
older one current. Commits are numbered, and of two writers that started from the same one
only the first gets the next. Each commit holds the number of rows and a digest of every table.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowloom.model import Graph
from flowloom.operators import assemble, digests, overlay, validate
from flowloom.operators.store import append_events
from flowloom.plans.commits import CommitLog
from flowloom.plans.lineage import written

PARTS = {"nodes": assemble.NODES, "edges": assemble.EDGES, "routes": assemble.ROUTES, "diagnostics": assemble.DIAGNOSTIC}


class GraphNotFound(LookupError):
    """The project has no snapshot."""


class RepositorySetMismatch(ValueError):
    """The project has snapshots, but of other repositories."""


class GraphContractError(ValueError):
    """A graph breaks the contract."""


class SnapshotConflict(RuntimeError):
    """Another writer has committed since this one started."""


class SnapshotDamaged(RuntimeError):
    """A stored table is not what was committed."""


@dataclass
class Store:
    """Snapshots, runs and events of one project and repository set under ``root``."""

    spark: SparkSession
    root: str
    project: str
    repository_set_id: str

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _project(self) -> str:
        return f"{self.root}/commits/{hashlib.sha256(self.project.encode()).hexdigest()}"

    def _log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self._project()}/{hashlib.sha256(self.repository_set_id.encode()).hexdigest()}")

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return self._log().latest()

    def save(self, graph: Graph, based_on: int | None = None) -> None:
        """Store ``graph`` as the commit after ``based_on``, by default the last one now; raises SnapshotConflict if there is such a commit."""
        based_on = self.version() if based_on is None else based_on
        observed = lambda rows: F.exists("evidence", lambda e: e["kind"] == "observed")
        if any(not rows.filter(observed(rows)).isEmpty() for rows in (graph.nodes, graph.edges)):
            raise GraphContractError("observed evidence is not stored in snapshots")
        version = uuid.uuid4().hex
        for name, schema in PARTS.items():
            rows = getattr(graph, name)
            rows = self.spark.createDataFrame([], schema) if rows is None else assemble.shaped(rows, schema)
            rows.write.parquet(f"{self.root}/snapshots/{version}/{name}")
        parts = {name: digests.total(self._part(version, name)) for name in PARTS}
        if not self._log().append(based_on + 1, json.dumps({"version": version, "parts": parts})):
            self._record(version, "conflict", f"commit {based_on + 1} is another's")
            raise SnapshotConflict(f"commit {based_on + 1} of {self.project} is another's")
        self._record(version, "saved", None)

    def _part(self, version: str, name: str) -> DataFrame:
        return self.spark.read.schema(PARTS[name]).parquet(f"{self.root}/snapshots/{version}/{name}")

    def clean(self, hours: float = 24) -> list[str]:
        """Delete snapshots that no commit of any project names and that have not changed for ``hours``; their names.

        These are what writers left that died or lost a race; younger ones may still be written.
        """
        log = self._log()
        named = {json.loads(r[0])["version"] for r in self.spark.read.option("recursiveFileLookup", True).text(f"{self.root}/commits", wholetext=True).select("value").toLocalIterator()} if log.folders(f"{self.root}/commits") else set()
        gone = [v for v, at in log.folders(f"{self.root}/snapshots").items() if v not in named and at < (time.time() - hours * 3600) * 1000]
        for v in gone:
            log.delete(f"{self.root}/snapshots/{v}")
        return gone

    def failed(self, reason: str) -> None:
        """Record a run that stored no snapshot; the older one stays current."""
        self._record(None, "failed", reason)

    def _record(self, version: str | None, status: str, reason: str | None) -> None:
        values = {"project": self.project, "repository_set_id": self.repository_set_id, "version": version, "status": status, "reason": reason}
        run = self.spark.range(1).select(*[F.lit(v).cast("string").alias(c) for c, v in values.items()], F.current_timestamp().alias("saved_at"))
        run.write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame | None:
        """All runs of this project and set, the failed ones too; None where nothing was ever stored."""
        runs = self._table("runs")
        return None if runs is None else runs.filter((F.col("project") == self.project) & (F.col("repository_set_id") == self.repository_set_id))

    def load(self, number: int | None = None, check: bool = False) -> Graph:
        """The graph of commit ``number``, by default the last; with ``check`` its tables are compared with what was committed."""
        log = self._log()
        number = log.latest() if number is None else number
        if not number:
            if log.folders(self._project()):
                raise RepositorySetMismatch(self.repository_set_id)
            raise GraphNotFound(self.project)
        commit = json.loads(log.read(number))
        if check:
            bad = [name for name, told in commit["parts"].items() if list(digests.total(self._part(commit["version"], name))) != told]
            if bad:
                raise SnapshotDamaged(f"commit {number}: {', '.join(bad)}")
        return Graph(**{name: self._part(commit["version"], name) for name in PARTS})

    def _events(self) -> DataFrame | None:
        """All stored events; the columns that folders are named after are text, whatever they look like."""
        stored = self._table("events")
        if stored is None:
            return None
        scope = ("project", "repository_set_id", "capture_id")
        schema = StructType([StructField(f.name, StringType()) if f.name in scope else f for f in stored.schema])
        return self.spark.read.schema(schema).parquet(f"{self.root}/events")

    def append_events(self, events: DataFrame) -> None:
        """Events (event_id, capture_id, ...) of this project and set, each id once."""
        scoped = events.withColumns({"project": F.lit(self.project), "repository_set_id": F.lit(self.repository_set_id), "capture_id": F.col("capture_id").cast("string")})
        stored = self._events()
        append_events(scoped, scoped.limit(0) if stored is None else stored, f"{self.root}/events")

    def events(self, capture_id: str) -> DataFrame | None:
        """The capture's events by receipt, read from its own folder; None where nothing was ever stored."""
        stored = self._events()
        mine = (F.col("project") == self.project) & (F.col("repository_set_id") == self.repository_set_id) & (F.col("capture_id") == capture_id)
        return None if stored is None else stored.filter(mine).orderBy("received_at", "event_id")


def analyze(store: Store, fragments: list[tuple[DataFrame, DataFrame, DataFrame | None]], proofs: DataFrame, namespaces: DataFrame) -> Graph:
    """Assemble ``fragments`` (nodes, edges, routes), check ids, ends and conflicts, store the graph and return it; whatever goes wrong is recorded as a failed run.

    The graph is stored as the commit after the last one at the start, so of two analyses at once one fails.
    """
    based_on = store.version()
    try:
        for nodes, _, _ in fragments:
            _strict(assemble.repeated_keys(nodes))
        graph, conflicts = assemble.merged([assemble.canonical(*f) for f in fragments], proofs, namespaces)
        _strict(conflicts)
        checked(graph)
        store.save(graph, based_on)
    except SnapshotConflict:
        raise
    except Exception as e:
        store.failed(str(e) if isinstance(e, GraphContractError) else f"{type(e).__name__}: {str(e)[:500]}")
        raise
    return store.load()


def checked(graph: Graph) -> Graph:
    """``graph`` if its edges have declared, legal ends and proper ids; raises GraphContractError otherwise."""
    _strict(validate.dangling(graph.nodes, graph.edges))
    _strict(validate.edge_violations(graph.edges))
    _strict(validate.illegal_edges(graph.nodes, graph.edges).select("id", F.lit("illegal").alias("rule")))
    return graph


def _strict(found: DataFrame) -> None:
    try:
        validate.strict(found)
    except ValueError as e:
        raise GraphContractError(str(e)) from e


def _runtime_tables(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(urls, views, links, calls) of a stored graph, as the overlay takes them."""
    nodes, edges = graph.nodes, graph.edges
    urls = nodes.filter("kind = 'django_url_pattern'").select(F.col("id").alias("url"), "endpoint_id")
    views = nodes.filter("kind = 'django_view'").select(F.col("id").alias("view"), F.col("identity_key").alias("view_name"))
    resolving = edges.filter("kind = 'resolves_to'")
    links = resolving.select(F.col("source").alias("url"), F.col("target").alias("view"), F.col("id").alias("link"))
    owners = nodes.filter("kind in ('http_call', 'request_payload')").select(F.col("id").alias("source"))
    calls = resolving.join(owners, "source", "left_semi").select(F.col("target").alias("url"), F.col("id").alias("edge"), "source")
    return urls, views, links, calls


def observed_outcomes(graph: Graph, events: DataFrame) -> DataFrame:
    """``overlay.match`` of events (event_id, endpoint_id, view_name) against a stored graph."""
    return overlay.match(events, *_runtime_tables(graph))


def overlaid(graph: Graph, events: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, diagnostics): the graph with the evidence of events (event_id, timestamp, endpoint_id, view_name), up to 32 pieces an item, and the events that fit nowhere.

    The stored graph is not touched: what events show is laid over it when it is read.
    """
    urls, views, links, calls = _runtime_tables(graph)
    matched = written(overlay.match(events, urls, views, links, calls))
    both = [rows.select("id", F.size("evidence").alias("n_evidence"), "confidence") for rows in (graph.nodes, graph.edges)]
    evidence, items = overlay.written_back(matched.filter("outcome = 'observed'"), links, both[0].union(both[1]))
    evidence = written(evidence)
    piece = F.struct(F.lit("observed").alias("kind"), F.lit("flowloom.runtime").alias("adapter"), F.lit("1").alias("adapter_version"), F.col("event_id").cast("string").alias("event_id"), "reason", F.col("timestamp").cast("string").alias("timestamp"))
    gained = evidence.groupBy("id").agg(F.collect_list(piece).alias("gained"))
    after = items.select("id", F.col("confidence").alias("lifted")).join(gained, "id")

    def laid(rows: DataFrame) -> DataFrame:
        new = rows.join(after, "id", "left")
        return new.select(*[F.array_sort(F.concat("evidence", F.coalesce("gained", F.array().cast(rows.schema["evidence"].dataType)))).alias(c) if c == "evidence" else F.coalesce("lifted", c).alias(c) if c == "confidence" else F.col(c) for c in rows.columns])

    return Graph(laid(graph.nodes), laid(graph.edges), graph.routes, graph.diagnostics), overlay.event_diagnostics(matched, urls, views, calls)
