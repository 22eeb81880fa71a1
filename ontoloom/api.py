"""Entry points for callers."""

from __future__ import annotations

import contextlib
import hashlib
import os
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BackendUnavailable, Cancelled, InvalidOptions, Nonconformance, ProjectionError, ProjectionWarning, ResourceLimit
from .operators.roles import RoleState, fold
from .options import Options
from .plans import projection as plan
from .sources.views import Ontology
from .streaming import distributed, sinks
from .streaming.sinks import Artifact, Edge


ARTIFACT_SCHEMA = "ontoloom-edges-1"


class Limits(NamedTuple):
    """What a call may use before it fails; None: no limit."""

    max_edges: int | None = None
    max_seconds: float | None = None


class CancellationToken:
    """Ends the jobs of the calls that it is given to, from any thread; such a call raises Cancelled."""

    def __init__(self):
        self.tag = f"projection-{uuid.uuid4().hex}"
        self.cancelled = False
        self.seconds: float | None = None  # the limit that ended the call
        self._spark = None

    def bind(self, spark: SparkSession) -> None:
        self._spark = spark
        spark.addTag(self.tag)
        self.check()

    def release(self) -> None:
        if self._spark is not None:
            self._spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        if self._spark is not None:
            self._spark.interruptTag(self.tag)

    def expire(self, seconds: float) -> None:
        self.seconds = seconds
        self.cancel()

    def check(self) -> None:
        if self.cancelled:
            raise self.reason()

    def reason(self) -> ProjectionError:
        if self.seconds is not None:
            return ResourceLimit(f"over {self.seconds} seconds", max_seconds=self.seconds)
        return Cancelled("the call was cancelled")


@dataclass(frozen=True)
class Report:
    profile: str
    options: dict
    edges: int
    distinct: int
    duplicates: int
    ignored_shapes: int
    skipped_axioms: int
    warnings: int
    diagnostics: tuple
    source_kind: str
    snapshot_sha256: str
    invocation: int
    diagnostics_sha256: str
    history_sha256: str
    backend: str = "spark"

    def warning_summary(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for code, _, severity, _, n in self.diagnostics:
            if severity == "warning":
                out[code] = out.get(code, 0) + n
        return out

    def metadata(self) -> dict:
        """What an artifact says of its edges: nothing that differs by backend. The keys."""
        return {
            "schema": ARTIFACT_SCHEMA, "profile": self.profile, "options": {k: v for k, v in self.options.items() if k != "backend"}, "snapshot": {"axioms_sha256": self.snapshot_sha256},
            "provenance": {"diagnostics_sha256": self.diagnostics_sha256, "invocation": self.invocation, "history_sha256": self.history_sha256},
            "counts": {"edges": self.edges, "duplicates": self.duplicates, "skipped_axioms": self.skipped_axioms, "ignored_shapes": self.ignored_shapes, "warnings": self.warnings},
            "warning_summary": self.warning_summary(), "artifact_hash_preimage": "metadata-without-artifact_sha256+edge-records",
        }


def load(source: Ontology | Callable[[], Ontology]) -> Ontology:
    """A view, or a provider of one, which is asked once."""
    view = source if isinstance(source, Ontology) else source()
    if not isinstance(view, Ontology):
        raise ProjectionError(f"not an ontology view: {type(view).__name__}")
    return view


def snapshot(view: Ontology) -> str:
    """A digest of the bag of axioms, whatever their order: of the counts and sums of hashes of canonical bytes by kind
    and document, which one aggregation finds."""
    parts = [view.axioms(k).select(F.lit(k).alias("kind"), "doc_id", F.xxhash64("canon").cast("decimal(38,0)").alias("h")) for k in view.kinds()]
    if not parts:
        return hashlib.sha256(sinks.record({"axioms": []})).hexdigest()
    found = reduce(DataFrame.unionByName, parts).groupBy("kind", "doc_id").agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("h"))
    return hashlib.sha256(sinks.record({"axioms": sorted(tuple(map(str, r)) for r in found.collect())})).hexdigest()


class Projector:
    """Holds default options and, under ``scala-instance``, the role state of all calls; such calls don't overlap: one
    lasts until its result is complete, its iterator ended or closed."""

    def __init__(self, options: Options | None = None):
        self.options = options or Options()
        self.last_report: Report | None = None
        self.last_view: Ontology | None = None
        self._state = RoleState()
        self._lock = threading.Lock()
        self._history = ""
        self._invocations = 0

    @contextlib.contextmanager
    def _call(self, view: Ontology, options: Options, token: CancellationToken | None = None) -> Iterator[tuple[DataFrame, int]]:
        """The table of roles for one call, and how many role axioms had a chain."""
        stateful = options.compatibility_state == "scala-instance"
        if stateful and not self._lock.acquire(blocking=False):
            raise InvalidOptions("compatibility_state='scala-instance' is non-concurrent", compatibility_state="scala-instance")
        try:
            if token:
                token.bind(view.spark)
            self.last_view = view
            self._invocations += 1
            state, chains = fold(view, self._state if stateful else None)
            yield state.table(view.spark), chains
        except Exception as e:
            if token and token.cancelled and not isinstance(e, ProjectionError):
                raise token.reason() from e
            raise
        finally:
            if token:
                token.release()
            if stateful:
                self._lock.release()

    def edges(self, view: Ontology, options: Options | None = None, limits: Limits = Limits()) -> DataFrame:
        """The ordered edges as a DataFrame; nothing is collected. A stateful call ends when the plan is made."""
        options = options or self.options
        with self._call(view, options) as (roles, _):
            return plan.projected(view, options, roles, limits.max_edges)

    def project(self, view: Ontology, options: Options | None = None, limits: Limits = Limits(), token: CancellationToken | None = None) -> list[Edge]:
        return list(self.iter_edges(view, options, limits, token))

    def project_with_report(self, view: Ontology, options: Options | None = None) -> tuple[list[Edge], Report]:
        options = options or self.options
        with self._call(view, options) as (roles, chains):
            edges = list(sinks.iterate(plan.projected(view, options, roles)))
            return edges, self._report(view, options, roles, chains)

    def _report(self, view: Ontology, options: Options, roles: DataFrame, chains: int) -> Report:
        counts = plan.edge_counts(plan.raw_edges(view, options, roles)).first()
        found = sorted((tuple(r) for r in plan.diagnostics(view, options).collect()), key=lambda r: tuple(map(str, r)))
        of = lambda code: sum(r[4] for r in found if r[0] == code)
        digest, number = snapshot(view), self._invocations
        item = sinks.record({"snapshot": digest, "options": options.semantic(), "invocation": number})
        stateful = options.compatibility_state == "scala-instance"
        history = hashlib.sha256((self._history.encode() if stateful else b"") + b"\0" + item).hexdigest()
        if stateful:
            self._history = history
        self.last_report = Report(
            options.profile, options.to_dict(), counts["raw_edges"] if options.duplicates == "preserve" else counts["distinct_edges"], counts["distinct_edges"], counts["duplicate_edges"],
            of(plan.IGNORED[0]) + chains, of(plan.SKIPPED[0]), sum(r[4] for r in found if r[2] == "warning"), tuple(found),
            view.source_kind, digest, number, hashlib.sha256(sinks.record({"diagnostics": found})).hexdigest(), history,
        )
        return self.last_report

    def iter_edges(self, view: Ontology, options: Options | None = None, limits: Limits = Limits(), token: CancellationToken | None = None) -> Iterator[Edge]:
        """Edges one after the other. ``max_seconds`` ends the jobs of the call when they are over, also before the first
        edge. In encounter order with duplicates kept, each category's edges come before later ones are read."""
        options = options or self.options
        token = token or CancellationToken()
        clock = None if limits.max_seconds is None else threading.Timer(limits.max_seconds, token.expire, (limits.max_seconds,))
        if clock:
            clock.daemon = True
            clock.start()
        try:
            with self._call(view, options, token) as (roles, _):
                staged = options.order == "encounter" and options.duplicates == "preserve"
                parts = plan.encountered(view, options, roles) if staged else iter([plan.projected(view, options, roles, limits.max_edges)])
                n = 0
                for part in parts:
                    for e in sinks.iterate(part):
                        token.check()
                        if staged and n == limits.max_edges:
                            raise ResourceLimit(f"more than {n} edges", max_total_edges=n, seen=n + 1)
                        n += 1
                        yield e
        finally:
            if clock:
                clock.cancel()

    def project_to_sink(self, view: Ontology, sink, options: Options | None = None, batch_edges: int = 10_000) -> int:
        options = options or self.options
        with self._call(view, options) as (roles, _):
            return sinks.to_sink(plan.projected(view, options, roles), sink, batch_edges)

    def project_to_tasks(self, view: Ontology, sink, options: Options | None = None, batch_edges: int = 10_000) -> int:
        """Like project_to_sink(), but tasks write: see distributed.to_tasks()."""
        options = options or self.options
        with self._call(view, options) as (roles, _):
            return distributed.to_tasks(plan.projected(view, options, roles), sink, batch_edges)

    def write_parts(self, view: Ontology, path: str, options: Options | None = None) -> dict:
        """An artifact that tasks write and read: a folder with a manifest that has all that write_artifact() says."""
        options = options or self.options
        with self._call(view, options) as (roles, chains):
            metadata = self._report(view, options, roles, chains).metadata()
            return distributed.write_parts(plan.projected(view, options, roles), path, metadata)

    def write_artifact(self, view: Ontology, path: str | os.PathLike, options: Options | None = None) -> Artifact:
        options = options or self.options
        with self._call(view, options) as (roles, chains):
            metadata = self._report(view, options, roles, chains).metadata()
            return sinks.write_artifact(plan.projected(view, options, roles), path, metadata)

    def canonical_digest(self, view: Ontology, options: Options | None = None) -> str:
        options = replace(options or self.options, order="canonical")
        with self._call(view, options) as (roles, _):
            return sinks.digest(plan.projected(view, options, roles))

    def taxonomy(self, view: Ontology, bidirectional: bool = False, **policy) -> DataFrame:
        return plan.taxonomy(view, bidirectional, **policy)

    def iter_taxonomy_edges(self, view: Ontology, bidirectional: bool = False, **policy) -> Iterator[Edge]:
        return sinks.iterate(self.taxonomy(view, bidirectional, **policy))


class BackendStatus(NamedTuple):
    available: bool
    reason: str | None = None


def probe_native_backend() -> BackendStatus:
    """The engine is Spark; it is there when a session is active."""
    if SparkSession.getActiveSession() is None:
        return BackendStatus(False, "no Spark session is active")
    return BackendStatus(True)


def select_backend(requested: str, probe: Callable[[], BackendStatus] = probe_native_backend) -> str:
    """``native`` asks for an engine that is up already. Otherwise a missing one, which the first query starts, is
    worth a warning under ``auto``."""
    Options(backend=requested)
    status = probe()
    if not status.available and requested == "native":
        raise BackendUnavailable(status.reason or "no engine", requested=requested)
    if not status.available and requested == "auto":
        warnings.warn(status.reason or "no engine", ProjectionWarning, stacklevel=2)
    return "spark"


def project_source(source, options: Options | None = None) -> list[Edge]:
    return Projector(options).project(load(source))


def iter_source_edges(source, options: Options | None = None) -> Iterator[Edge]:
    return Projector(options).iter_edges(load(source))


def project_taxonomy(source, bidirectional: bool = False) -> list[Edge]:
    return list(sinks.iterate(plan.taxonomy(load(source), bidirectional)))


def iter_taxonomy_edges(source, bidirectional: bool = False) -> Iterator[Edge]:
    return Projector().iter_taxonomy_edges(load(source), bidirectional)


def canonical_edges_sha256(source, options: Options | None = None) -> str:
    return Projector(options).canonical_digest(load(source))


def write_edge_artifact(source, path, options: Options | None = None) -> Artifact:
    return Projector(options).write_artifact(load(source), path)


def verify(view: Ontology, expected: dict[str, tuple[Options, list[tuple[str, str, str]]]]) -> None:
    """Each case's edges in canonical order, else Nonconformance."""
    for name, (options, edges) in expected.items():
        found = [tuple(e) for e in Projector(options).project(view)]
        if found != [tuple(e) for e in edges]:
            raise Nonconformance(f"{name}: {len(found)} edges, {len(edges)} expected, or others", case=name)
