"""Telemetry as rows: middleware records what was handled, and counters, gauges and histograms are queries over the records."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import RevisionConflict, RuleViolation, SkippedEvent
from tidelog.plans.ranks import rank_sorted
from tidelog.plans.skew import spread_join

# Upper bounds in seconds of command durations, and of all others.
COMMAND_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
OTHER_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)

# Names of what records and spans are labelled with; programs put a prefix of their own in front.
ATTRIBUTES = (
    "command.type",
    "aggregate.id",
    "stream.id",
    "stream.version",
    "event.type",
    "event.id",
    "events.count",
    "event.global_position",
    "event.stream_position",
    "query.type",
    "query.id",
    "query.result_type",
    "query.result_count",
    "subscriber.name",
    "handler.name",
    "result",
    "error.type",
    "error.message",
    "retry.count",
    "retry.max",
    "operation",
    "conflict.type",
    "shard.id",
    "queue.depth",
)

SCHEMA = "kind string, name string, operation string, result string, error string, events long, started double, seconds double, conflict boolean, labels map<string,string>"


class Recorder:
    """Collects records; ``table`` shows them as a DataFrame, ``flush`` appends them to a folder."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def add(self, kind: str, name: str, operation: str, started: float, seconds: float, error: BaseException | None = None, events: int = 0, **labels: str) -> None:
        result = "success" if error is None else "skipped" if isinstance(error, SkippedEvent) else "failure"
        row = (kind, name, operation, result, type(error).__name__ if error else None, events if error is None else 0, started, seconds, isinstance(error, RevisionConflict), labels)
        with self._lock:
            self._rows.append(row)

    def table(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def timed(recorder: Recorder, kind: str, name: Callable[[Any], str] | None = None, operation: str | None = None, events: Callable[[Any], int] = lambda _: 0, **labels: Callable[[Any], str]) -> Callable:
    """Middleware that records each call: its duration in seconds, its outcome, and events only if it succeeded."""

    def layer(handler: Callable[[Any], Any]) -> Callable[[Any], Any]:
        def call(message: Any) -> Any:
            started, error, out = time.time(), None, None
            begin = time.perf_counter()
            try:
                out = handler(message)
                return out
            except BaseException as e:
                error = e
                raise
            finally:
                what = name(message) if name else type(message).__name__
                recorder.add(kind, what, operation or kind, started, time.perf_counter() - begin, error, events(out) if error is None else 0, **{k: f(message) for k, f in labels.items()})

        return call

    return layer


def logged(logger: logging.Logger, kind: str) -> Callable:
    """Middleware that logs the start and the end of each call; rejections by rule are warnings, other failures errors."""

    def layer(handler: Callable[[Any], Any]) -> Callable[[Any], Any]:
        def call(message: Any) -> Any:
            what = type(message).__name__
            logger.debug("%s %s begins", kind, what)
            begin = time.perf_counter()
            try:
                out = handler(message)
            except SkippedEvent:
                logger.debug("%s %s skipped", kind, what)
                raise
            except RuleViolation as e:
                logger.warning("%s %s rejected: %s", kind, what, e)
                raise
            except Exception as e:
                logger.error("%s %s failed after %.3f s: %s", kind, what, time.perf_counter() - begin, e)
                raise
            logger.info("%s %s done in %.3f s", kind, what, time.perf_counter() - begin)
            return out

        return call

    return layer


def stamped(handler_metadata: dict[str, str], **more: str) -> dict[str, str]:
    """Metadata with causation, correlation and trace entries; those given last win, empty ones are left out."""
    return {**handler_metadata, **{k: v for k, v in more.items() if v}}


def attribute(name: str, prefix: str = "") -> str:
    """A label by its fixed name; a name that is none of these is an error, so labels are the same everywhere."""
    if name not in ATTRIBUTES:
        raise ValueError(f"{name!r} is no attribute")
    return f"{prefix}.{name}" if prefix else name


_span: ContextVar[tuple[str, str] | None] = ContextVar("span", default=None)


def traced(recorder: Recorder, kind: str, parent: Callable[[Any], str] | None = None, **labels: Callable[[Any], str]) -> Callable:
    """Middleware that records each call as a span: labels trace_id, span_id and parent_id.

    A call inside another one is its child. ``parent`` reads the producer's ``<trace>-<span>`` from a message (such as the ``traceparent`` of an event's
    metadata): the call then belongs to that trace. ``current_trace`` is what to stamp new events with.
    """

    def layer(handler: Callable[[Any], Any]) -> Callable[[Any], Any]:
        def call(message: Any) -> Any:
            outer = _span.get()
            linked = parent(message) if parent else ""
            trace, above = tuple(linked.split("-", 1)) if linked else outer or (uuid.uuid4().hex, "")
            token = _span.set((trace, uuid.uuid4().hex[:16]))
            ids = {"trace_id": lambda _: trace, "span_id": lambda _, own=_span.get(): own[1], "parent_id": lambda _: above}
            try:
                return timed(recorder, kind, **{**labels, **ids})(handler)(message)
            finally:
                _span.reset(token)

        return call

    return layer


def current_trace() -> str:
    """``<trace>-<span>`` of the call under way, empty outside of one."""
    now = _span.get()
    return "-".join(now) if now else ""


def trace_links(log: DataFrame, key: str = "correlation_id") -> DataFrame:
    """trace, event_id, global_version, producer_id: each event of a trace with the event that began it. Events without the key have
    no trace. A trace of very many events is joined in several tasks."""
    traced_ = log.select(F.element_at("metadata", key).alias("trace"), "event_id", "global_version").where("trace is not null and trace != ''")
    first = traced_.groupBy("trace").agg(F.min_by("event_id", "global_version").alias("producer_id"), F.count(F.lit(1)).alias("n"))
    return spread_join(traced_, first, ["trace"], "n", F.col("global_version")).select("trace", "event_id", "global_version", "producer_id")


def counters(records: DataFrame, *labels: str) -> DataFrame:
    """calls, failures, conflicts and events by label."""
    return records.groupBy(*labels).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("result") == "failure").alias("failures"), F.count_if("conflict").alias("conflicts"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def histogram(rows: DataFrame, value: str | Column, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """One row for each label and upper bound: how many values are at most the bound (the last bound, null, takes all)."""
    value = F.col(value) if isinstance(value, str) else value
    cells = [F.struct(F.lit(float(b)).alias("le"), F.count_if(value <= b).alias("n")) for b in bounds]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("n")))
    return rows.groupBy(*labels).agg(F.array(*cells).alias("cells")).select(*labels, F.inline("cells"))


def in_flight(records: DataFrame, *labels: str) -> DataFrame:
    """The number of calls under way after each start and end; a label with very many calls is summed in ranges of time."""
    starts = records.select(*labels, F.col("started").alias("moment"), F.lit(1).alias("step"))
    ends = records.select(*labels, (F.col("started") + F.col("seconds")).alias("moment"), F.lit(-1).alias("step"))
    return rank_sorted(starts.unionByName(ends), list(labels), ["moment", F.desc("step")], "in_flight", weight="step")


class ObservedStore:
    """A store whose appends and loads are recorded, and whose events carry causation, correlation and trace entries.

    Events count as appended only if the append succeeded; a conflict counts as one.
    """

    def __init__(self, store: Any, recorder: Recorder, context: Callable[[], dict[str, str]] = dict) -> None:
        self.store, self.recorder, self.context = store, recorder, context

    def append(self, rows: list[dict], *args: Any) -> Any:
        extra = self.context()
        stamped_rows = [{**r, "metadata": stamped(r.get("metadata") or {}, **extra)} for r in rows]
        call = timed(self.recorder, "store", name=lambda m: m[0].get("stream_id", "") if m else "", operation="append", events=lambda _: len(rows))
        return call(lambda m: self.store.append(m, *args))(stamped_rows)

    def read(self, *args: Any) -> Any:
        return timed(self.recorder, "store", name=lambda _: "log", operation="load")(lambda _: self.store.read(*args))(None)

    def head(self, stream_id: str) -> int:
        return self.store.head(stream_id)


def stream_listener(recorder: Recorder) -> Any:
    """A StreamingQueryListener that records each micro-batch as handled rows, and a query that ends with an error."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event: Any) -> None:
            pass

        def onQueryProgress(self, event: Any) -> None:
            p = event.progress
            recorder.add("subscription", p.name or str(p.id), "batch", time.time(), (p.durationMs or {}).get("triggerExecution", 0) / 1000, None, int(p.numInputRows))

        def onQueryTerminated(self, event: Any) -> None:
            if event.exception:
                recorder.add("subscription", str(event.id), "end", time.time(), 0.0, RuntimeError(event.exception))

    return Listener()
