"""Decisions: commands against folded state, to new events or rejections.

In bulk: commands are joined with the state of their streams, decided by a column expression, numbered behind the heads and
committed together; thousands of streams take one job. Commands on one stream in one bulk are decided against the same
state, so give each stream at most one, or use ``serial_decisions``, which folds each decision into the next.
One at a time: ``CommandHandler`` loads, folds, decides and appends, and tries again from the newly committed tail on a conflict.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.envelope import ANY, NO_STREAM, STREAM_EXISTS, AppendResult, Revision, StreamState
from tidelog.errors import RevisionConflict, RuleViolation, StreamAlreadyExists
from tidelog.functions.metadata import merge_metadata
from tidelog.plans.commit import LogStore


def with_state(commands: DataFrame, state: DataFrame, by: str = "stream_id", **initial: Column) -> DataFrame:
    """Each command with its stream's state (left join); ``initial`` fills in for streams without events."""
    out = commands.join(state.withColumnRenamed("version", "head"), by, "left")
    fill = {"head": F.lit(0).cast("long"), **initial}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def check_expectation(expected: Column | str, head: Column | str) -> Column:
    """null if the head is as expected (a raw stream state), else what is wrong."""
    expected = F.col(expected) if isinstance(expected, str) else expected
    head = F.col(head) if isinstance(head, str) else head
    return (
        F.when(expected == -1, None)
        .when((expected == 0) & (head > 0), "stream_exists")
        .when((expected == -2) & (head == 0), "stream_not_found")
        .when((expected > 0) & (expected != head), "conflict")
        .when(expected < -2, "invalid_revision")
    )


@dataclass
class Decisions:
    """events (numbered, ready to append) and rejections (command_id, stream_id, kind, message)."""

    events: DataFrame
    rejections: DataFrame


def decide_batch(commands: DataFrame, decide: Column, reject: Column | None = None, metadata: Iterable[Column] = ()) -> Decisions:
    """commands: command_id, stream_id, head, expected and whatever the expressions read.

    ``decide``: array of structs (event_type, payload); empty or null: nothing happens, which is a success.
    ``reject``: null, or the message of a violated rule. Metadata maps are merged, later ones win.
    """
    broken = check_expectation("expected", "head")
    violated = F.lit(None).cast("string") if reject is None else reject
    judged = commands.withColumn("__kind", F.coalesce(broken, F.when(violated.isNotNull(), F.lit("rule")))).withColumn("__message", F.coalesce(broken, violated))
    rejections = judged.where(F.col("__kind").isNotNull()).select("command_id", "stream_id", F.col("__kind").alias("kind"), F.col("__message").alias("message"))
    meta = merge_metadata(*metadata, F.create_map(F.lit("causation_id"), F.col("command_id").cast("string")))
    events = judged.where(F.col("__kind").isNull()).select("command_id", "stream_id", "head", meta.alias("metadata"), F.posexplode(decide).alias("__pos", "__event"))
    own = Window.partitionBy("stream_id").orderBy("command_id", "__pos")
    numbered = events.select("stream_id", "command_id", (F.col("head") + F.row_number().over(own)).alias("version"), F.col("__event.event_type").alias("event_type"), F.col("__event.payload").alias("payload"), "metadata")
    return Decisions(numbered, rejections)


def serial_decisions(work: DataFrame, decide: Callable[[Any, dict], list[dict]], evolve: Callable[[Any, dict], Any], initial: Callable[[], Any], columns: list[str], by: str = "stream_id") -> DataFrame:
    """Commands of one key, one after the other, each against the state that the ones before left behind.

    work: ``by`` (the stream, or a shard of streams), seq, stream_id, command_id and ``columns``. A decision that raises an error
    that ``rejects`` (RuleViolation, or a class with that attribute), or any other error, gives a rejection row and the next
    command goes on. Returns stream_id, command_id, version, event_type, payload, kind, message. A task reads its keys'
    commands in order, batch by batch, and holds the states of one key, so a key of very many commands needs time but no memory.
    """

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = None
        states: dict[str, Any] = {}
        heads: dict[str, int] = {}
        for pdf in batches:
            out = []
            for command in pdf.to_dict("records"):
                if command[by] != key:
                    key, states, heads = command[by], {}, {}
                stream = command["stream_id"]
                state, head = states.get(stream) if stream in states else initial(), heads.get(stream, 0)
                try:
                    made, rows = decide(state, command) or [], []
                    for event in made:
                        head += 1
                        state = evolve(state, event)
                        rows.append((stream, command["command_id"], head, event["event_type"], event.get("payload"), None, None))
                    states[stream], heads[stream] = state, head
                    out += rows
                except Exception as e:  # noqa: BLE001  a failing handler must not stop the others
                    rule = getattr(e, "rejects", False)
                    out.append((stream, command["command_id"], None, None, None, "rule" if rule else "failed", str(e) if rule else f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["stream_id", "command_id", "version", "event_type", "payload", "kind", "message"])
            yield frame.astype({"version": "Int64"})

    kind = work.schema["command_id"].dataType.simpleString()
    schema = f"stream_id string, command_id {kind}, version long, event_type string, payload string, kind string, message string"
    needed = list(dict.fromkeys([by, "seq", "stream_id", "command_id", *columns]))
    return work.select(*needed).repartition(by).sortWithinPartitions(by, "seq").mapInPandas(in_order, schema)


@dataclass
class CommandHandler:
    """One command at a time against a store.

    ``evolve(state, event)`` gets rows of the envelope; ``decide(state, command)`` returns dicts (event_type, payload) or raises.
    ANY and STREAM_EXISTS append behind the head that was read and try again on a conflict; NO_STREAM and Revision are what
    the caller asserts and are not retried. The first event of a new stream is appended as such, so two creators never both win.
    """

    store: LogStore
    initial: Callable[[], Any]
    evolve: Callable[[Any, Any], Any]
    decide: Callable[[Any, Any], list[dict]]
    expected: StreamState = ANY
    retries: int = 0
    pause: float = 0.05
    stream_name: Callable[[Any], str] = lambda command: command.aggregate_id
    metadata: list[Callable[[Any], dict[str, str]]] = field(default_factory=list)

    def __call__(self, command: Any) -> AppendResult:
        stream = self.stream_name(command)
        state, version = self.initial(), 0
        converges = self.expected in (ANY, STREAM_EXISTS)
        for attempt in range(self.retries + 1):
            log = self.store.read()
            rows = log.load_stream_from(stream, self.expected if not isinstance(self.expected, Revision) and attempt == 0 else ANY)
            for row in rows.where(F.col("version") > version).toLocalIterator():  # a retry folds the new tail only
                state, version = self.evolve(state, row), row["version"]
            try:
                made = self.decide(state, command)
            except Exception as e:
                if getattr(e, "rejects", False):
                    raise
                raise RuleViolation(e) from e
            if not made:
                return AppendResult(True, stream, version)
            base: dict[str, str] = {}
            for extract in self.metadata:
                base |= extract(command)
            events = [{"event_id": str(uuid.uuid4()), "stream_id": stream, "metadata": dict(base), **event} for event in made]
            target = (Revision(version) if version else NO_STREAM) if converges else self.expected
            try:
                return self.store.append(events, target)
            except (RevisionConflict, StreamAlreadyExists) as e:
                if not converges or attempt == self.retries:
                    raise e if isinstance(e, RevisionConflict) or not converges else RevisionConflict(stream, version, self.store.head(stream)) from e
                time.sleep(self.pause * 2**attempt)
        raise AssertionError
